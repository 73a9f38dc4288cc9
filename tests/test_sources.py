"""Text files, binary folders, scratch storage, records and pages."""

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfold import storage
from wayfold.functions.text import strip_suffix
from wayfold.plans import creative, listings
from wayfold.sources.delimited import read_delimited, warn_skipped, write_delimited
from wayfold.sources.images import gray_png, scan_image_parts, scan_images, write_images
from wayfold.sources.tables import write_clustered


def test_delimited_rows(spark, tmp_path, rows):
    (tmp_path / "a.csv").write_text('id|name|v\n1|a "b|2.5\n2|short\n3|x|1.0|extra\n4||\n5|"q"|0.5\n')
    schema = T.StructType.fromDDL("id int, name string, v double")
    out = read_delimited(spark, str(tmp_path), schema)
    assert out.count() == 4
    assert out.select("v").where("v > 1").count() == 1
    assert rows(out) == [(1, 'a "b', 2.5), (2, "short", None), (4, None, None), (5, '"q"', 0.5)]


@pytest.mark.parametrize("sep", ["|", ","])
def test_delimited_round_trip(spark, tmp_path, rows, sep):
    texts = ["a|b", "a,b", "two\nlines", "cr\r\nlf", 'a "quote"', '"', "", None, "  blanks  ", "\\", "\\|", "é", "#x", "\x01"]
    df = spark.createDataFrame([(k, t, k / 3, t) for k, t in enumerate(texts)], "id int, a string, v double, b string")
    write_delimited(df, str(tmp_path / "t"), sep)
    assert rows(read_delimited(spark, str(tmp_path / "t"), df.schema, sep, quoted=True)) == rows(df)


@pytest.mark.parametrize("quoted", [False, True])
def test_long_rows_are_counted_and_warned_about(spark, tmp_path, quoted):
    (tmp_path / "a.csv").write_text("id|name\n1|a\n2|b|more\n3\n4|c|x|y\n")
    skipped = Observation("skipped")
    out = read_delimited(spark, str(tmp_path), T.StructType.fromDDL("id int, name string"), quoted=quoted, skipped=skipped)
    assert sorted(r.id for r in out.collect()) == [1, 3]
    with pytest.warns(UserWarning, match="2 rows"):
        assert warn_skipped(skipped, "a.csv") == 2


@pytest.mark.parametrize("spread", [1, 4])
def test_clustered_files(spark, tmp_path, spread):
    df = spark.range(4000).select((F.col("id") % 97).alias("k"), "id")
    write_clustered(df, f"wf_spread_{spread}", ["k"], 8, str(tmp_path / "c"), spread)
    files = [f.name for f in (tmp_path / "c").glob("part-*.parquet")]
    assert len(files) == 8 * spread
    assert spark.table(f"wf_spread_{spread}").count() == 4000
    spark.sql(f"DROP TABLE wf_spread_{spread}")


def test_images(spark, tmp_path, rows):
    import base64

    payload = bytes(range(256))
    (tmp_path / "one.png").write_bytes(payload)
    (tmp_path / "two.jpg").write_bytes(b"no")
    assert rows(scan_images(spark, str(tmp_path))) == [("one.png", 256, base64.b64encode(payload).decode())]


def test_image_parts_and_headers(spark, tmp_path):
    import base64

    good = gray_png(bytes(range(200)), 50)
    files = {"good.png": good, "bad.png": good[:17] + b"\x01" + good[18:], "text.png": b"no image", "gray.png": gray_png(b"x" * 51, 51)}
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    (tmp_path / "empty.png").write_bytes(b"")
    found = scan_image_parts(spark, str(tmp_path), part_bytes=30).orderBy("file_name", "part").collect()
    for name, content in files.items():
        parts = [r for r in found if r.file_name == name]
        assert [r.part for r in parts] == list(range(-(-len(content) // 30)))
        assert max(len(r.payload) for r in parts) <= 40
        assert base64.b64decode("".join(r.payload for r in parts)) == content
    facts = {r.file_name: (r.n_bytes, r.width, r.height, r.intact) for r in found}
    assert facts["good.png"] == (len(good), 50, 4, True)
    assert facts["bad.png"][3] is False
    assert facts["text.png"] == (8, None, None, None) and facts["gray.png"] == (120, 51, 1, True)
    assert "empty.png" not in facts
    with pytest.raises(ValueError, match="multiple of three"):
        scan_image_parts(spark, str(tmp_path), part_bytes=10)


def test_written_images_are_read_back(spark, tmp_path, rows):
    names = [f"image {k}%.png" for k in range(20)]
    df = spark.createDataFrame([(n, bytearray(n.encode())) for n in names], "file_name string, pixels binary").repartition(4)
    told = rows(write_images(df, str(tmp_path / "out")))
    found = scan_images(spark, str(tmp_path / "out"))
    assert rows(found, "file_name", "n_bytes") == told and len(told) == 20
    assert rows(write_images(df, str(tmp_path / "out"))) == told  # a task that runs again


def test_cut_reads_back(spark, rows):
    df = spark.range(10).withColumn("x", F.col("id") * 2)
    back = storage.cut(df)
    assert rows(back) == rows(df)
    assert "FileScan parquet" in back._jdf.queryExecution().executedPlan().toString()


def test_scratch_goes_with_the_session(spark):
    from pathlib import Path

    folder = Path(storage.session_folder(spark))
    storage.cut(spark.range(3), "mine")
    assert any(p.name.startswith("mine-") for p in folder.iterdir())
    storage.drop_scratch(spark)
    assert not folder.exists()


def test_scratch_needs_a_shared_folder(monkeypatch):
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://somewhere:7077"

    class Session:
        conf = Conf()
        sparkContext = Context()

    with pytest.raises(ValueError, match="checkpoint"):
        storage.scratch_root(Session())


def test_record_defaults(spark):
    df = spark.createDataFrame(
        [
            ("a.png", '{"subject": "hi", "subject_length": 2, "offer_flag": true, "offer_value": 5}'),
            ("b.png.png", '{"subject_length": "many", "offer_flag": "perhaps"}'),
            ("c.jpg", "not json"),
        ],
        "f string, j string",
    )
    out = {r["file_name"]: r for r in creative.parse_records(df, "j", "f").collect()}
    assert set(out) == {"a", "b.png", "c.jpg"}
    assert (out["a"]["subject"], out["a"]["subject_length"], out["a"]["offer_flag"], out["a"]["offer_value"]) == (
        "HI", 2, True, "5",
    )
    for name in ("b.png", "c.jpg"):
        r = out[name]
        assert (r["subject"], r["subject_length"], r["offer_flag"], r["offer_value"], r["color_theme"]) == (
            "", 0, False, "0", False,
        )
    assert len(creative.RECORD_FIELDS) == 19


def test_text_features(spark):
    df = spark.createDataFrame([(1, "Save 20 % now\nVisit us"), (2, "FREE drink"), (3, "$ 5 off\nline"), (4, "plain")], "i int, t string")
    out = {r["i"]: r for r in creative.text_features(df, "t").collect()}
    assert [out[i]["offer_type"] for i in (1, 2, 3, 4)] == ["Discount Offer", "Free Item Offer", "Discount Offer", "No Offer"]
    assert [out[i]["offer_value"] for i in (1, 2, 3, 4)] == ["20%", "0", "$5", "0"]
    assert (out[1]["subject_length"], out[1]["body_length"], out[2]["body_length"]) == (13, 8, 0)
    assert out[1]["cta_visit_restaurant"] and not out[4]["cta_visit_restaurant"]
    assert out[4]["email_tone"] == "Others"


def test_listing_defaults(spark):
    fields = [
        listings.PageField("name", "<a>([^<]*)</a>", "Null"),
        listings.PageField("address", "<span>([^<]*)</span>", "Unknown"),
        listings.PageField("rating", 'aria-label="([^"]*)"', "0", "first_token"),
        listings.PageField("review_count", "<b>([^<]*)</b>", "0"),
        listings.PageField("feedback", "<p>([^<]*)</p>", "None", "before_dots"),
    ]
    full = '<li><a> Bar </a><span>Here</span><i aria-label="4.5 star rating"/><b>12</b><p>Good food...more</p></li>'
    df = spark.createDataFrame([(1, full + "<li></li>"), (2, "nothing")], "id int, html string")
    out = listings.extract_listings(df, "html", "(?s)<li>.*?</li>", fields).orderBy("position").collect()
    assert [tuple(r) for r in out] == [
        (1, 0, "Bar", "Here", "4.5", "12", "Good food"),
        (1, 1, "Null", "Unknown", "0", "0", "None"),
    ]


def test_nested_blocks():
    card, box = '<div class="card">', "<div>"
    page = f"a{card}1{box}2</div>{card}3</div></div>b<DIV class='card'/>{box}{card}4</div></div></div>{card}5{box}6"
    found = listings.blocks_of(page, "div", 'class="card"')
    assert found == [f"{card}1{box}2</div>{card}3</div></div>", f"{card}3</div>", f"{card}4</div>", f"{card}5{box}6"]
    assert listings.blocks_of("", "div", "x") == [] and listings.blocks_of("</div>" * 3, "div", "") == []
    assert listings.blocks_of("<divider>x</divider>", "div", "") == []


def test_fields_come_from_their_own_block(spark):
    fields = [listings.PageField("name", "<a>([^<]*)</a>", "Null"), listings.PageField("rating", "<i>([^<]*)</i>", "0")]
    inner = '<div class="card"><a>In</a></div>'
    html = f'<div class="card"><div><a>Out</a></div><i>5</i>{inner}</div><div class="card"></div>'
    df = spark.createDataFrame([("here", html), ("there", None)], "location string, html string")
    blocks = listings.nested_blocks(F.col("html"), "div", "card")
    out = listings.extract_listings(df, "html", blocks, fields).orderBy("position").collect()
    assert [tuple(r) for r in out] == [("here", 0, "Out", "5"), ("here", 1, "In", "0"), ("here", 2, "Null", "0")]


def test_search_requests(spark):
    df = spark.createDataFrame([("New York",)], "zip string")
    url = lambda route: listings.search_requests(
        df, "zip", "https://listings.example", route, "listings", {"find_desc": "a b"}
    ).first()["url"]
    assert url("/search") == "https://listings.example/search?find_desc=a%20b&find_loc=New%20York&start=0"
    assert url("https://listings.example/x").startswith("https://listings.example/x?")


def test_strip_suffix(spark):
    df = spark.createDataFrame([("a.png",), ("apng",), ("a.png.x",)], "f string")
    assert [r[0] for r in df.select(strip_suffix(F.col("f"), ".png")).collect()] == ["a", "apng", "a.png.x"]


def test_clustered_join_needs_no_shuffle(spark, tmp_path):
    from wayfold.sources.tables import write_clustered

    rows = spark.range(1000).select((F.col("id") % 50).alias("k"), "id")
    a = write_clustered(rows, "clustered_a", ["k"], 4, str(tmp_path / "a"))
    b = write_clustered(rows.where("id < 50"), "clustered_b", ["k"], 4, str(tmp_path / "b"), spread=3)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = a.join(b, "k")
        assert joined.count() == 1000
        assert "hashpartitioning" not in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_left_join_many_equals_left_join(spark, rows):
    from wayfold.operators.joins import left_outer, left_outer_many

    left = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c"), (1, "d")], "k int, l string")
    right = spark.createDataFrame([(1, 10), (1, 11), (3, 12), (None, 13)], "k int, r int")
    assert rows(left_outer_many(left, right, ["k"]), "k", "l", "r") == rows(left_outer(left, right, ["k"]), "k", "l", "r")
