"""Column layouts shared by the operators."""

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, dtype) for name, dtype in fields.items()])


_S, _I, _L, _TS = T.StringType(), T.IntegerType(), T.LongType(), T.TimestampType()

# One entry of the league list file.
LEAGUE_ENTRY = _struct(
    code=_S,
    footballDataId=_S,
    oddscheckerPath=_S,
    bbcName=_S,
    thefishyId=_I,
    rounds=_I,
    isActive=T.BooleanType(),
)
LEAGUES = T.StructType([*LEAGUE_ENTRY.fields, T.StructField("league_idx", _I)])

# One entry of a league's dictionary file.
ENTITY_ENTRY = _struct(name=_S, altNames=T.ArrayType(_S))
ENTITY_ALIASES = _struct(
    league=_S, entity_pos=_I, alias_pos=_I, entity=_S, alias=_S, alias_norm=_S
)

RAW_PAGES = _struct(
    page_id=_L, source=_S, league=_S, url=_S, status=_I, body=_S, fetched_at=_TS
)
RESULTS = _struct(
    page_id=_L, source=_S, league=_S, pos=_I, date=_S, name=_S, score=_S, fetched_at=_TS
)

# Arrival order of one result row: later fetch wins, then later page, then later row.
ARRIVAL = _struct(fetched_at=_TS, page_id=_L, pos=_I)
EVENTS = _struct(
    league=_S,
    name=_S,
    date=_S,
    bbc_score=_S,
    fishy_score=_S,
    created_at=_TS,
    updated_at=_TS,
    bbc_order=ARRIVAL,
    fishy_order=ARRIVAL,
)
