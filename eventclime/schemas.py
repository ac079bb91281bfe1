"""Fixed record layouts.

The event line layout, the weather line layout and the station line layout are
fixed values: they must equal the public file formats the jobs read.
"""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values: event TSV column groups, in file order -------------------
ACTOR_FIELDS = [
    ("code", "string"), ("name", "string"), ("countryCode", "string"),
    ("knownGroupCode", "string"), ("ethnicCode", "string"),
    ("religion1Code", "string"), ("religion2Code", "string"),
    ("type1Code", "string"), ("type2Code", "string"), ("type3Code", "string"),
]
GEO_FIELDS = [
    ("type", "int"), ("name", "string"), ("countryCode", "string"),
    ("adm1Code", "string"), ("lat", "double"), ("long", "double"),
    ("featureId", "int"),
]
# top-level entries: (name, type) or (group name, group fields)
EVENT_LAYOUT = [
    ("globalEventID", "long"), ("day", "date"), ("month", "int"), ("year", "int"),
    ("fracDate", "double"),
    ("actor1Code", ACTOR_FIELDS), ("actor2Code", ACTOR_FIELDS),
    ("isRoot", "boolean"), ("eventCode", "string"), ("eventBaseCode", "string"),
    ("eventRootCode", "string"), ("quadClass", "int"), ("goldstein", "double"),
    ("numMentions", "int"), ("numSources", "int"), ("numArticles", "int"),
    ("avgTone", "double"),
    ("actor1Geo", GEO_FIELDS), ("actor2Geo", GEO_FIELDS), ("eventGeo", GEO_FIELDS),
    ("dateAdded", "date"), ("sourceUrl", "string"),
]
# --- end of fixed values ----------------------------------------------------

GROUPS = {name: spec for name, spec in EVENT_LAYOUT if isinstance(spec, list)}


def flat_event_columns() -> list[tuple[str, str]]:
    """The 58 flat (name, type) pairs in file order; groups become group_child."""
    out: list[tuple[str, str]] = []
    for name, spec in EVENT_LAYOUT:
        if isinstance(spec, list):
            out.extend((f"{name}_{child}", typ) for child, typ in spec)
        else:
            out.append((name, spec))
    return out


EVENT_COLUMNS = flat_event_columns()
EVENT_TOKENS = len(EVENT_COLUMNS)  # 58

_SPARK_TYPES = {
    "int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(), "string": T.StringType(),
    "date": T.DateType(), "boolean": T.BooleanType(),
}

EVENT_SCHEMA = T.StructType(
    [T.StructField(n, _SPARK_TYPES[t], True) for n, t in EVENT_COLUMNS]
)

# Weather line: the first four comma-separated fields are used (id, date
# yyyyMMdd, element, value); public files carry four more flag columns.
WEATHER_FIELDS = ["id", "date", "element", "datavalue"]
WEATHER_SCHEMA = T.StructType([
    T.StructField("id", T.StringType(), True),
    T.StructField("date", T.DateType(), True),
    T.StructField("element", T.StringType(), True),
    T.StructField("datavalue", T.StringType(), True),
])

# Station line: blank-separated id, latitude, longitude, then free text.
STATION_SCHEMA = T.StructType([
    T.StructField("id", T.StringType(), True),
    T.StructField("latitude", T.DoubleType(), True),
    T.StructField("longitude", T.DoubleType(), True),
    T.StructField("ord", T.LongType(), True),
])

# Result CSV written by the jobs and read back by the plotter.
RESULT_SCHEMA = "window_start string, clz string, value double"
