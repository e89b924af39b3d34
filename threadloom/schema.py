"""Table shapes shared by every operator."""

from pyspark.sql import types as T

S, D, L, I = T.StringType(), T.DoubleType(), T.LongType(), T.IntegerType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


REPORTS = _struct(case_id=S, doc_id=L, doc_kind=S, text=S)
CASES = _struct(case_id=S, name=S, created_at=T.TimestampType())
ENTITIES = _struct(case_id=S, label=S, id=S, value=S, source=S, props=T.MapType(S, S))
EDGES = _struct(
    src_case=S, src_label=S, src_id=S, rel=S, dst_case=S, dst_label=S, dst_id=S,
    confidence=D, source_sentence=S, last_timestamp=S, last_duration=S,
)
CALLS = _struct(case_id=S, row_no=L, caller=S, called=S, ts_raw=S, duration_raw=S)
TRANSACTIONS = _struct(
    case_id=S, row_no=L, from_account=S, to_account=S, amount=D, currency=S,
    ts_raw=S, description=S, kind=S,
)
AUDIT = _struct(case_id=S, seq=L, ts=S, action=S, details=S, prev_hash=S, hash=S)
LINKS = _struct(type=S, case_a=S, id_a=S, case_b=S, id_b=S, match_kind=S, score=D)

NODE_KEY = ["case_id", "label", "id"]
EDGE_KEY = ["src_case", "src_label", "src_id", "rel", "dst_case", "dst_label", "dst_id"]
EDGE_COLUMNS = [f.name for f in EDGES.fields]
LABELS = ["Person", "Location", "Vehicle", "Phone", "Organization"]
DISPLAY_PROPERTY = {
    "Person": "name",
    "Location": "name",
    "Vehicle": "plate",
    "Phone": "number",
    "Organization": "name",
    "BankAccount": "account_number",
}
