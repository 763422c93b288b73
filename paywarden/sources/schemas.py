"""Explicit schemas; nothing is inferred."""

from pyspark.sql import types as T

_S, _D, _L, _I, _TS = T.StringType(), T.DoubleType(), T.LongType(), T.IntegerType(), T.TimestampType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


GEO = _struct(country=_S, lat=_D, lng=_D)

TRANSACTION_EVENT = _struct(
    transaction_id=_S, id=_S, user_id=_S, sender_id=_S, merchant_id=_S, amount=_D, currency=_S,
    transaction_type=_S, type=_S, device_fingerprint=_S, device_id=_S, ip_address=_S,
    sender_wallet_id=_S, receiver_wallet_id=_S, channel=_S, mcc_code=_S, timestamp=_TS,
)
CHARGEBACK_EVENT = _struct(transaction_id=_S, timestamp=_TS)
PARTNER_FEEDBACK = _struct(prediction_id=_S, domain=_S, label=_I, partner_id=_S)

FRAUD_REQUEST = _struct(
    transaction_id=_S, user_id=_S, amount=_D, currency=_S, transaction_type=_S, device_fingerprint=_S,
    ip_address=_S, geo=GEO, merchant_id=_S, timestamp=_TS, metadata=T.MapType(_S, _S),
)
PREDICTION = _struct(
    prediction_id=_L, domain=_S, entity_id=_S, transaction_id=_L, score=_D, level=_S, decision=_S,
    created_at=_TS, label=_I, labeled_at=_TS,
)
EDGE = _struct(src=_L, dst=_L, edge_type=_S, weight=_D, shared_entity_count=_L, first_seen=_L, last_seen=_L)
PSEUDO_LABEL = _struct(prediction_id=_L, domain=_S, source=_S, label=_I, confidence=_D, iteration=_I)
EXPORT_MANIFEST = _struct(
    export_type=_S, format=_S, record_count=_L, range_start=_L, range_end=_L, path=_S, content_hash=_S,
)
