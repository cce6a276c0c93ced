"""Rule scoring, join and KPIs on the worked examples."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from siftline.config import (
    DEFAULT_RULES,
    JUNK_PHRASES,
    VIP_PHRASES,
    RuleBook,
)
from siftline.functions import first_keyword
from siftline.operators.enrich import (
    enrich,
    enrich_compact,
    expand_copies,
    match_counts,
    score_and_enrich,
)
from siftline.operators.metrics import (
    class_counts,
    class_distribution,
    display_names,
    kpis,
    score_histogram,
)
from siftline.operators.rules import ColumnClash, score_inline, score_leads

NEUTRAL = "Lead bình thường (nhu cầu hợp lý)"
LEADS = [
    ("1", "Cần mua biệt thự ven sông, ngân sách 25 tỷ"),
    ("2", "Thuê bao, không bắt máy"),
    ("3", "Căn hộ 2 phòng ngủ, 3 tỷ"),
    ("4", "Penthouse quận 1 nhưng hỏi giá cho vui"),
    ("5", "Nhà ở quận 10"),
    ("6", None),
    ("7", ""),
    ("1", "Mua sỉ 5 căn"),
    (None, "vay vốn"),
    ("8", unicodedata.normalize("NFD", "biệt thự")),
    ("9", "NGÂN SÁCH 20 TỶ"),
    ("10", "Quỹ 120 tỷ"),
]
SCORED = [
    ("1", 50.0, "HOT", "VIP: Chứa từ khóa 'biệt thự'"),
    ("2", -50.0, "JUNK", "Rác: Chứa từ khóa 'thuê bao'"),
    ("3", 10.0, "WARM", NEUTRAL),
    ("4", -50.0, "JUNK", "VIP: Chứa từ khóa 'penthouse'; Rác: Chứa từ khóa 'hỏi giá cho vui'"),
    ("5", 50.0, "HOT", "VIP: Chứa từ khóa 'quận 1'"),
    ("6", 10.0, "WARM", NEUTRAL),
    ("7", 10.0, "WARM", NEUTRAL),
    ("1", 50.0, "HOT", "VIP: Chứa từ khóa 'mua sỉ'"),
    (None, -50.0, "JUNK", "Rác: Chứa từ khóa 'vay vốn'"),
    ("8", 10.0, "WARM", NEUTRAL),
    ("9", 50.0, "HOT", "VIP: Chứa từ khóa '20 tỷ'"),
    ("10", 50.0, "HOT", "VIP: Chứa từ khóa '20 tỷ'"),
]


def rows(df, *order):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple(map(str, r)))


def srt(items):
    return sorted(items, key=lambda r: tuple(map(str, r)))


@pytest.fixture
def leads(spark):
    return spark.createDataFrame(LEADS, "id string, nhu_cau_mo_ta string")


def test_score_leads(leads):
    assert rows(score_leads(leads)) == srt(SCORED)


def test_missing_columns(spark):
    df = spark.createDataFrame([("a",)], "id string")
    assert rows(score_leads(df)) == [("a", 10.0, "WARM", NEUTRAL)]
    df = spark.createDataFrame([("penthouse",)], "nhu_cau_mo_ta string")
    assert rows(score_leads(df)) == [(None, 50.0, "HOT", "VIP: Chứa từ khóa 'penthouse'")]


def test_enrich_fans_out(leads):
    scored = score_leads(leads)
    final = enrich(leads, scored)
    expected = [
        (i, text, *s[1:]) for i, text in LEADS for s in SCORED if s[0] == i
    ]
    assert len(expected) == 14
    assert rows(final) == srt(expected)
    for table in (final, enrich_compact(leads, scored), match_counts(leads, scored)):
        (k,) = rows(kpis(table))
        assert k == (14, 7, 4, 3, 11 / 14 * 100)
        assert rows(class_counts(table)) == [("HOT", 7), ("JUNK", 3), ("WARM", 4)]
        assert rows(score_histogram(table)) == srt([(50.0, 7), (10.0, 4), (-50.0, 3)])
    (k,) = rows(kpis(score_inline(leads)))
    assert k == (12, 5, 4, 3, 9 / 12 * 100)


def test_many_copies(spark):
    leads = spark.range(700).select(F.lit("x").alias("id"), F.lit("biệt thự").alias("nhu_cau_mo_ta"))
    compact = enrich_compact(leads, score_leads(leads))
    assert compact.count() == 700
    assert expand_copies(compact).count() == 490_000
    assert kpis(match_counts(leads, score_leads(leads))).first().total == 490_000
    big = compact.limit(1).withColumn("_copies", F.lit(65_536 * 2 + 3).cast("bigint"))
    nos = expand_copies(big, numbered=True).agg(F.count("*"), F.min("_copy"), F.max("_copy")).first()
    assert tuple(nos) == (131_075, 0, 131_074)
    for spread in (True, False):
        sizes = [1, 63, 64, 65, 128, 129, 10_000, 64 * 65_536 + 1]
        mixed = spark.createDataFrame([(str(n), n) for n in sizes], "id string, _copies bigint")
        got = expand_copies(mixed, numbered=True, spread=spread).groupBy("id")
        got = got.agg(F.count("*"), F.min("_copy"), F.max("_copy"), F.countDistinct("_copy"))
        assert {tuple(r) for r in got.collect()} == {(str(n), n, 0, n - 1, n) for n in sizes}
    edge = compact.limit(1).withColumn("_copies", F.lit(65_536).cast("bigint"))
    assert expand_copies(edge).count() == 65_536


def test_hot_rows_multiply_in_many_tasks(spark, tmp_path):
    """All rows of the hot id lie in one file; their copies come from all tasks."""
    hot = spark.range(500, numPartitions=1).select(F.lit("hot").alias("id"), F.lit(500).cast("bigint").alias("_copies"))
    hot.write.parquet(str(tmp_path / "t"))
    rows = expand_copies(spark.read.parquet(str(tmp_path / "t")), spread=True)
    per_task = rows.groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in per_task) == 250_000
    assert len(per_task) >= 4 and max(r["count"] for r in per_task) < 150_000


def test_unscored_and_invented_ids(spark):
    leads = spark.createDataFrame([(i,) for i in "12345"], "id string")
    scored = spark.createDataFrame(
        [("1", 50.0, "HOT", "a"), ("2", -50.0, "JUNK", "b"), ("3", 10.0, "Warm", "c"), ("99", 50.0, "HOT", "d")],
        "id string, score double, classification string, reason string",
    )
    final = enrich(leads, scored)
    assert rows(final) == srt(
        [("1", 50.0, "HOT", "a"), ("2", -50.0, "JUNK", "b"), ("3", 10.0, "Warm", "c"),
         ("4", None, None, None), ("5", None, None, None)]
    )
    for table in (final, enrich_compact(leads, scored), match_counts(leads, scored)):
        assert rows(kpis(table)) == [(5, 1, 0, 1, 20.0)]
        assert [tuple(r) for r in class_distribution(kpis(table)).collect()] == [
            ("HOT (VIP)", 1), ("WARM (Thường)", 0), ("JUNK (Rác)", 1)
        ]
        assert rows(score_histogram(table)) == srt([(50.0, 1), (10.0, 1), (-50.0, 1)])
        assert rows(class_counts(table)) == [("HOT", 1), ("JUNK", 1), ("Warm", 1)]


def test_empty_table(spark):
    leads = spark.createDataFrame([], "id string, nhu_cau_mo_ta string")
    final = enrich(leads, score_leads(leads))
    assert rows(kpis(final)) == [(0, 0, 0, 0, 0.0)]
    assert [r.n for r in class_distribution(kpis(final)).collect()] == [0, 0, 0]


def test_score_columns_are_rejected(spark):
    leads = spark.createDataFrame([("1", "x")], "id string, score string")
    with pytest.raises(ColumnClash):
        score_inline(leads)
    with pytest.raises(ColumnClash):
        enrich(leads, score_leads(leads))


def test_display_names(leads):
    named = display_names(score_histogram(score_inline(leads)), {"score": "Điểm số", "n": "Số lượng khách"})
    assert named.columns == ["Điểm số", "Số lượng khách"]


def expected_score(text, rules):
    """The scoring rules restated in plain Python."""
    text = (text or "").lower()
    vip = next((p for p in rules.vip_phrases if p in text), None)
    junk = next((p for p in rules.junk_phrases if p in text), None)
    score = -50.0 if junk else 50.0 if vip else 10.0
    label = "JUNK" if junk else "HOT" if vip else "WARM"
    parts = []
    if vip:
        parts.append(f"VIP: Chứa từ khóa '{vip}'")
    if junk:
        parts.append(f"Rác: Chứa từ khóa '{junk}'")
    return score, label, "; ".join(parts) or NEUTRAL


def test_random_texts(spark):
    rng = random.Random(7)
    words = [*VIP_PHRASES, *JUNK_PHRASES, "quận", "1", "2", "0 tỷ", "\n", "İ", "ß", "'", "Ω", "không", " "]
    texts = []
    for _ in range(3000):
        text = "".join(rng.choice(["", " "]) + rng.choice(words) for _ in range(rng.randint(0, 6)))
        texts.append(rng.choice([str.upper, str.lower, str.title])(text))
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "id string, nhu_cau_mo_ta string")
    got = {int(r.id): (r.score, r.classification, r.reason) for r in score_leads(df).collect()}
    assert got == {i: expected_score(t, DEFAULT_RULES) for i, t in enumerate(texts)}


@pytest.mark.parametrize("n", [150, 250, 1500])
def test_long_phrase_lists(spark, n):
    phrases = [f"w{i} " for i in range(n)]
    rng = random.Random(3)
    texts = ["".join(f"w{rng.randint(0, 400)} " for _ in range(4)) for _ in range(500)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(first_keyword(F.col("t"), phrases)).collect()]
    assert got == [next((p for p in phrases if p in t), None) for t in texts]
    assert df.select(first_keyword(F.col("t"), [])).distinct().collect()[0][0] is None


def test_other_rule_book(spark):
    rules = RuleBook(vip_phrases=("b", "a"), junk_phrases=(), vip_reason="<{}>", neutral_reason="-")
    df = spark.createDataFrame([("1", "a b"), ("2", "A"), ("3", "c")], "id string, nhu_cau_mo_ta string")
    assert rows(score_leads(df, rules)) == [
        ("1", 50.0, "HOT", "<b>"), ("2", 50.0, "HOT", "<a>"), ("3", 10.0, "WARM", "-")
    ]


def test_works_on_a_stream(spark, leads, tmp_path):
    """Scoring is a projection, so leads arriving as files can be scored as they come."""
    source = str(tmp_path / "in")
    leads.write.parquet(source)
    stream = spark.readStream.schema(leads.schema).parquet(source)
    query = (
        score_leads(stream).writeStream.format("memory").queryName("scored_stream")
        .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    )
    query.awaitTermination(120)
    assert rows(spark.table("scored_stream")) == srt(SCORED)


def test_score_and_enrich_equals_join(spark, leads):
    """Repeated ids, a missing id, and one id in a third of all rows."""
    texts = ["biệt thự", "thuê bao", "nhà", "quận 1, bảo hiểm", None]
    n = 300
    hot = spark.createDataFrame(
        [("hot" if i % 3 == 0 else None if i % 50 == 1 else str(i // 4), texts[i % 5], i) for i in range(n)],
        "id string, nhu_cau_mo_ta string, n int",
    )
    unique = hot.withColumn("id", F.col("n").cast("string"))
    for table in (leads, hot, unique):
        want = enrich_compact(table, score_leads(table))
        got = score_and_enrich(table)
        assert got.columns == want.columns and dict(got.dtypes) == dict(want.dtypes)
        assert rows(got) == rows(want)
        assert rows(expand_copies(got)) == rows(table.join(
            score_leads(table).withColumnRenamed("id", "sid"), F.col("id").eqNullSafe(F.col("sid")), "left"
        ).drop("sid"))


def test_many_repeated_ids_are_shuffled(spark, leads):
    """Where Spark finds the table of repeated ids too large, the result is the same and nothing
    is broadcast."""
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = score_and_enrich(leads)
        assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
        assert rows(got) == rows(enrich_compact(leads, score_leads(leads)))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_plan_of_seldom_repeated_ids_moves_no_leads(spark, tmp_path):
    path = str(tmp_path / "leads")
    spark.range(5000).select(
        F.when(F.col("id") < 4000, F.col("id")).otherwise(F.col("id") % 2).cast("string").alias("id"),
        F.lit("penthouse").alias("nhu_cau_mo_ta"),
    ).write.parquet(path)
    table = spark.read.parquet(path)
    got = score_and_enrich(table)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
    assert kpis(got).first().total == 3998 + 2 * 501 * 501


def test_scoring_plan(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(
        F.col("doc_id").alias("id"), F.col("text").alias("nhu_cau_mo_ta"), "lang"
    )
    plan = score_leads(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and plan.count("lower(") == 1
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan


@pytest.mark.parametrize("empty", [False, True])
def test_long_lists_equal_short_ones(spark, empty):
    """The automaton gives the phrase that the chain gives: list order, phrases inside others, repeats."""
    rng = random.Random(9)
    letters = "abcé\U0001f600 \x00"
    phrases = ["".join(rng.choice(letters) for _ in range(rng.randint(2, 5))) for _ in range(150)]
    phrases[40:60] = phrases[:20]
    if empty:
        phrases[90] = ""
    texts = ["".join(rng.choice(letters + "xyz") for _ in range(rng.randint(0, 6))) for _ in range(500)] + [None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    hit = first_keyword(F.col("t"), phrases)
    assert "pythonUDF" in df.select(hit)._jdf.queryExecution().executedPlan().toString()
    got = [(r[0], r[1]) for r in df.select("t", hit).collect()]
    assert got == [(t, None if t is None else next((p for p in phrases if p in t), None)) for t in texts]
    assert len({p for _, p in got}) > 10
