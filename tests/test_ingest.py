"""Crafted edge lines for the text sources."""

import tempfile


from eventclime.schemas import EVENT_COLUMNS
from eventclime.sources import text


def _line(**over):
    vals = {n: "" for n, _ in EVENT_COLUMNS}
    vals.update({"globalEventID": "1", "day": "20170201", "isRoot": "1", "eventGeo_lat": "40.5",
                 "quadClass": "4", "sourceUrl": "http://x"})
    vals.update(over)
    return [vals[n] for n, _ in EVENT_COLUMNS]


def _write(lines):
    d = tempfile.mkdtemp(prefix="eventclime-ingest-")
    with open(f"{d}/part.tsv", "w", newline="") as f:
        for ln in lines:
            f.write(ln + "\n")
    return d


def test_event_edge_lines(spark):
    full = _line()
    lines = [
        "\t".join(full),                                          # id 1: ok
        "\t".join(_line(globalEventID="2")[:57]),                 # 57 tokens: kept
        "\t".join(_line(globalEventID="3")[:52]),                 # 52: reject
        "\t".join(_line(globalEventID="4") + ["extra"]),          # 59: reject
        "\t".join(_line(globalEventID="5", day="20171332")),      # bad day
        "\t".join(_line(globalEventID="6", day="20170201xx")),    # bad day
        "\t".join(_line(globalEventID="7", day="")),              # empty day
        "\t".join(_line(globalEventID="8", eventGeo_featureId="AB12", eventGeo_lat="x")),
        "\t".join(_line(globalEventID="9", numMentions=" 5 ", quadClass="5.0")),
        "\t".join(_line(globalEventID="10", isRoot="0")),
        "\t".join(_line(globalEventID="11", isRoot="")),
        "\t".join(_line(globalEventID="12", sourceUrl="u")) + "\r",  # CRLF
        "\t".join(_line(globalEventID="13", actor1Code_name='"a')),
    ]
    d = _write(lines)
    good = {r.globalEventID: r for r in text.read_events(spark, d).collect()}
    rej = {r.line.split("\t")[0]: (r.n_tokens, r.reason) for r in text.read_event_rejects(spark, d).collect()}
    assert set(good) == {1, 2, 8, 9, 10, 11, 12, 13}
    assert rej == {"3": (52, "token_count"), "4": (59, "token_count"), "5": (58, "bad_day"),
                   "6": (58, "bad_day"), "7": (58, "bad_day")}
    assert good[2].sourceUrl is None and good[1].sourceUrl == "http://x"
    assert good[8].eventGeo_lat is None and good[8].eventGeo_featureId is None
    assert good[9].numMentions is None and good[9].quadClass is None
    assert good[1].isRoot is True and good[10].isRoot is False and good[11].isRoot is None
    assert good[12].sourceUrl == "u"
    assert good[13].actor1Code_name == '"a'
    assert str(good[1].day) == "2017-02-01"


def test_weather_lines(spark):
    d = _write(["USC1,20170201,TMAX", "USC1,20170201,TMAX,33,,,7,", "USC2,20170202,TMIN,-10", "USC3,2017xx01,TMAX,1"])
    ok = text.read_weather(spark, d).collect()
    assert sorted(r.id for r in ok) == ["USC1", "USC2"]
    rej = sorted((r.n_tokens, r.reason) for r in text.read_weather_rejects(spark, d).collect())
    assert rej == [(3, "token_count"), (4, "bad_date")]


def test_station_lines_keep_order(spark):
    d = _write(["USC00000001  40.0000 -100.0000  100.0 TX A", "USW00000003  35.0  -95.0  10 B",
                "USC00000002  30.0  -90.0  5 C", "BAD  x  1"])
    rows = text.read_stations(spark, d).orderBy("ord").collect()
    assert [r.id for r in rows] == ["USC00000001", "USW00000003", "USC00000002"]
    assert rows[0].latitude == 40.0 and rows[2].longitude == -90.0


def test_struct_view_roundtrip(spark):
    d = _write(["\t".join(_line())])
    flat = text.read_events(spark, d)
    nested = text.event_struct_view(flat)
    assert set(nested.columns) >= {"actor1Code", "actor2Code", "actor1Geo", "actor2Geo", "eventGeo"}
    assert nested.select("eventGeo.lat").first()[0] == 40.5
    back = text.flatten_struct_view(nested)
    assert sorted(back.columns) == sorted(flat.columns)


def test_carriage_returns_and_long_ids(spark):
    d = _write(["\t".join(_line(globalEventID="3000000000", actor1Code_name="a\rb")),
                "\t".join(_line(globalEventID="5", sourceUrl="")) + "\r"])
    rows = {r.globalEventID: r for r in text.read_events(spark, d).collect()}
    assert set(rows) == {3_000_000_000, 5}
    assert rows[3_000_000_000].actor1Code_name == "a\rb" and rows[5].sourceUrl is None
    assert text.read_event_rejects(spark, d).count() == 0
