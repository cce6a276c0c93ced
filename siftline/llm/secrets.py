"""Secret scans: fixed patterns, and Markov models that tell random strings from identifiers.

Everything here is column expressions; only the bounded table of letter pairs passes the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import need

# Fixed patterns of the base rules. Letters of the assigned name match in either case.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
VALUE_LENGTH = 6

RUN = "A-Za-z0-9+/_=-"
RUN_LENGTH = 20
SAMPLE_LENGTH = 8
CANDIDATE = f"[{RUN}]{{{RUN_LENGTH},}}"
PART = f"[A-Za-z0-9+]{{{RUN_LENGTH},}}"
KINDS = (("[a-z]", 26), ("[A-Z]", 26), ("[0-9]", 10))
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
SIDE = len(LETTERS) + 1
TRAIN_DOCS = 20_000
ORDINARY_DOCS = 400
SMOOTHING = 40.0
MIN_RATIO = 0.7
MIN_LETTERS = 8
# Labelled ordinary words, joined to identifiers by ``shaped``.
WORDS = """
    about account active after all available back base before between body both browser build byte call
    category channel check city clean client cluster collection command common complete connection context
    convert count create customer database debug default description device different disable distance domain
    download duplicate edge email encode entity error every exception expected export factory feature file
    find fixed float follow forward function generate global group hash health help home icon image index
    initial insert integer invoice job json keep key label last left level light line list local lock long
    manager market master maximum member merge method minimum model month multiple network node notify number
    offset operation order owner page parse path payment permission pixel plugin policy position prefix
    primary priority process profile property provider public quality query quick rate record reference
    register remote render report require resource result review role route runtime save schedule screen
    search security send serialize service set shape shipping simple size source special stack start static
    step store string subject summary switch system target team temporary text thread time token total
    transaction transform tree type unknown upload utility value vector version virtual volume warning width
    word worker write zero
""".split()
CHUNK = 512
MARK = "[SECRET]"
ORDER = ("assign", "access", "hex", "model")
SPAN = "array<struct<start:int,place:int,kind:string,end:int>>"


def running(values: Column) -> Column:
    """Sum of all values before each one. Chunks are summed first, so that a long array costs its
    length times the chunk, not its square."""
    chunks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(values) - 1) / CHUNK).cast("int")),
        lambda i: F.slice(values, i * CHUNK + 1, CHUNK),
    )

    def before(xs: Column) -> Column:
        start = F.struct(F.lit(0).alias("sum"), F.array().cast("array<int>").alias("all"))
        return F.aggregate(
            xs, start,
            lambda acc, x: F.struct((acc["sum"] + x).alias("sum"), F.array_append(acc["all"], acc["sum"]).alias("all")),
            lambda acc: acc["all"],
        )

    sums = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + x))
    parts = F.zip_with(chunks, before(sums), lambda c, base: F.transform(before(c), lambda x: x + base))
    return F.when(F.size(values) > 0, F.flatten(parts)).otherwise(F.array().cast("array<int>"))


def _split(table: DataFrame, pattern: str, group: int = 0) -> DataFrame:
    """Columns ``gaps`` (text between matches, one more than those), ``hits`` and ``values`` (the
    group's text of each)."""
    p = F.lit(pattern)
    none = F.array().cast("array<string>")
    hit = F.col("text").rlike(pattern)
    table = table.withColumn("hits", F.when(hit, F.regexp_extract_all("text", p, F.lit(0))).otherwise(none))
    some = F.size("hits") > 0
    table = table.withColumn("gaps", F.when(some, F.split("text", pattern, -1)).otherwise(none))
    return table.withColumn(
        "values", F.when(some, F.regexp_extract_all("text", p, F.lit(group))).otherwise(none) if group else F.col("hits")
    )


def _spans(table: DataFrame, name: str, pattern: str, group: int = 0, least: int = 0, kind: str | None = None) -> DataFrame:
    """Column ``name`` with the spans of the pattern in code points, ``least`` letters or more in
    the group. A match that is too short still uses up its text."""
    table = _split(table, pattern, group)
    steps = F.zip_with(F.slice("gaps", 1, F.greatest(F.size("hits"), F.lit(0))), F.col("hits"), lambda g, h: F.length(g) + F.length(h))
    table = table.withColumn("before", running(steps))
    spans = F.transform(
        F.col("hits"),
        lambda h, i: F.struct(
            (F.get("before", i) + F.length(F.get("gaps", i))).alias("start"),
            F.lit(ORDER.index(kind or name)).alias("place"),
            F.lit(kind or name).alias("kind"),
            (F.get("before", i) + F.length(F.get("gaps", i)) + F.length(h)).alias("end"),
            F.get("values", i).alias("value"),
        ),
    )
    long_enough = F.filter(spans, lambda s: F.length(s["value"]) >= least)
    return table.withColumn(name, long_enough).drop("hits", "gaps", "values", "before")


def _base(table: DataFrame) -> DataFrame:
    table = _spans(table, "assign", ASSIGN, 2, VALUE_LENGTH)
    return _spans(_spans(table, "access", ACCESS), "hex", HEX)


def shaped(words: list[str]) -> list[str]:
    """Ordinary identifiers: two to five of the words in snake, camel, constant, path, dashed and address form, a
    third of them with a number."""
    made = []
    for i in range(len(words)):
        low = [words[(i * 7 + j * 31) % len(words)] for j in range(2 + i % 4)]
        high = [w.capitalize() for w in low]
        forms = (
            "_".join(low), low[0] + "".join(high[1:]), "".join(high), "_".join(low).upper(), "/".join(low), "-".join(low),
            "//" + "/".join(low[1:]) + "=" + low[0],
        )
        for k, form in enumerate(forms):
            number = ("", "_", "-", "/v")[i % 4] + str(i * i % 10 ** (1 + i % 4))
            made.append(form + number if (i + k) % 3 == 0 else form)
    return made


def _codes(token: Column) -> Column:
    """Numbers of neighbouring letters of a string, as one number for each pair of unlike letters."""
    place = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(LETTERS), c))
    pairs = F.zip_with(
        F.slice(place, 1, F.greatest(F.size(place) - 1, F.lit(0))), F.slice(place, 2, F.size(place)),
        lambda a, b: a * SIDE + b,
    )
    return F.filter(pairs, lambda c: c % (SIDE + 1) != 0)


def _logs(counts: dict[int, float]) -> list[float]:
    """Log-probability of each letter after each, a pair's count smoothed by the letter's own frequency."""
    pairs = [[counts.get(a * SIDE + b, 0.0) for b in range(SIDE)] for a in range(SIDE)]
    total = sum(map(sum, pairs))
    alone = [(sum(row[b] for row in pairs) + 0.5) / (total + 0.5 * SIDE) for b in range(SIDE)]
    return [math.log((row[b] + SMOOTHING * alone[b]) / (sum(row) + SMOOTHING)) for row in pairs for b in range(SIDE)]


def train(docs: DataFrame, sample_docs: int = TRAIN_DOCS, words: list[str] = WORDS) -> tuple[list[float], list[float]]:
    """Log-probability of each letter after each, for ordinary identifiers and for random strings.

    Labelled samples: values of base spans are random strings; ``words`` in all shapes of identifiers are
    ordinary, and so are other runs of letters of those documents and of about ``ORDINARY_DOCS`` more, which
    together weigh as much as half of the shapes. All documents come from about ``sample_docs``, by the hash of their id.
    A letter after itself says nothing: rules of dashes are neither.
    """
    n = docs.count()
    share, plain = (min(1 << 30, int((1 << 30) * k / max(1, n))) for k in (sample_docs, ORDINARY_DOCS))
    some = docs.where("text is not null").select(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)).alias("draw"), "text")
    base = _base(some.where(F.col("draw") < share))
    random = F.transform(F.concat("assign", "access", "hex"), lambda s: s["value"])
    base = base.select("draw", "text", random.alias("random")).where((F.size("random") > 0) | (F.col("draw") < plain))
    runs = F.regexp_extract_all("text", F.lit(f"[{RUN}]{{{SAMPLE_LENGTH},}}"), F.lit(0))
    samples = base.select(
        F.explode(
            F.concat(
                F.transform(F.array_distinct("random"), lambda t: F.struct(F.lit(1).alias("label"), t.alias("token"))),
                F.transform(F.array_except(runs, "random"), lambda t: F.struct(F.lit(0).alias("label"), t.alias("token"))),
            )
        ).alias("s")
    ).select("s.label", F.explode(_codes(F.col("s.token"))).alias("pair"))
    counts: list[dict[int, float]] = [{}, {}]
    for r in samples.groupBy("label", "pair").count().collect():
        counts[r["label"]][r["pair"]] = float(r["count"])
    shapes: dict[int, float] = {}
    for token in shaped(words):
        for a, b in zip(token, token[1:]):
            if a != b:
                pair = (LETTERS.index(a) + 1) * SIDE + LETTERS.index(b) + 1
                shapes[pair] = shapes.get(pair, 0.0) + 1.0
    weight = min(1.0, 0.5 * sum(shapes.values()) / max(1.0, sum(counts[0].values()))) if shapes else 1.0
    for pair, count in counts[0].items():
        shapes[pair] = shapes.get(pair, 0.0) + weight * count
    return _logs(shapes), _logs(counts[1])


def _ratio(token: Column, model: tuple[list[float], list[float]]) -> Column:
    """Mean log-likelihood ratio of a string's letters, random over ordinary. Of two random models, the learned
    one and an even choice among the kinds of letters that the string has, the likelier counts."""
    ordinary, learned = (F.split(F.lit(",".join(f"{x:.6f}" for x in m)), ",").cast("array<double>") for m in model)
    codes = _codes(token)
    total = lambda table: F.aggregate(codes, F.lit(0.0), lambda acc, c: acc + F.get(table, c))
    letters = sum(F.when(token.rlike(kind), F.lit(size)).otherwise(0) for kind, size in KINDS)
    symbols = F.size(F.filter(F.array_distinct(F.split(token, "")), lambda c: c.rlike("[+/_=-]")))
    even = -F.log(F.greatest(letters + symbols, F.lit(2)).cast("double")) * F.size(codes)
    return (F.greatest(total(learned), even) - total(ordinary)) / F.greatest(F.length(token) - 1, F.lit(1))


def _is_random(token: Column, model: tuple[list[float], list[float]], min_ratio: float) -> Column:
    return (F.size(F.array_distinct(F.split(token, ""))) >= MIN_LETTERS) & (_ratio(token, model) >= min_ratio)


def _outside(run: Column) -> Column:
    """The parts of a run, of ``RUN_LENGTH`` letters or more, that lie outside of all spans of ``base``."""
    part = lambda a, b: F.struct(a.alias("start"), b.alias("end"))
    met = F.filter("base", lambda b: (b["start"] < run["end"]) & (run["start"] < b["end"]))
    start = F.struct(run["start"].alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("parts"))
    parts = F.aggregate(
        met, start,
        lambda acc, b: F.struct(
            F.greatest(acc["at"], b["end"]).alias("at"), F.array_append(acc["parts"], part(acc["at"], b["start"])).alias("parts")
        ),
        lambda acc: F.array_append(acc["parts"], part(acc["at"], run["end"])),
    )
    return F.transform(
        F.filter(parts, lambda p: p["end"] - p["start"] >= RUN_LENGTH),
        lambda p: F.struct(
            p["start"].alias("start"), run["place"].alias("place"), run["kind"].alias("kind"), p["end"].alias("end"),
            F.substring(run["value"], p["start"] - run["start"] + 1, p["end"] - p["start"]).alias("value"),
        ),
    )


def scan(docs: DataFrame, model: tuple[list[float], list[float]] | None = None, min_ratio: float = MIN_RATIO) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, n_model, base_sha256, spans`` for every row of ``docs``
    (``doc_id, text``).

    A span is ``kind:start:end`` in code points, the end exclusive, ordered by start, then kind. To
    the base spans the model adds runs of 20 letters or more, 8 of them different, whose mean
    log-likelihood ratio is ``min_ratio`` or more. Runs are cut at base spans, and what is left of them
    is judged part by part; so are the parts of 20 letters or more between ``/ _ = -`` of a run that is not
    random as a whole. A null or empty text has no span (its
    ``base_sha256`` is that of the empty string). Repeated rows and rows without doc_id are
    scanned like others; an empty table gives an empty one.
    """
    model = train(docs) if model is None else model
    table = need(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    table = _spans(_base(table), "model", CANDIDATE, 0, RUN_LENGTH)
    table = _spans(table, "part", PART, 0, RUN_LENGTH, kind="model")
    drop = lambda c: F.transform(
        F.col(c), lambda s: F.struct(s["start"].alias("start"), s["place"].alias("place"), s["kind"].alias("kind"), s["end"].alias("end"))
    )
    table = table.withColumn("base", F.array_sort(F.concat(drop("assign"), drop("access"), drop("hex"))))
    for name in ("model", "part"):
        table = table.withColumn(
            name, F.filter(F.flatten(F.transform(name, _outside)), lambda s: _is_random(s["value"], model, min_ratio))
        )
    inside = lambda p: F.exists("model", lambda m: (m["start"] <= p["start"]) & (p["end"] <= m["end"]))
    table = table.withColumn("model", F.concat("model", F.filter("part", lambda p: ~inside(p))))
    table = table.withColumn("every", F.array_sort(F.concat("base", drop("model"))))
    text = lambda c: F.array_join(
        F.transform(F.col(c), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )
    return table.select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in ORDER),
        F.sha2(text("base").cast("binary"), 256).alias("base_sha256"),
        text("every").alias("spans"),
    )


def redact(docs: DataFrame, model: tuple[list[float], list[float]] | None = None, min_ratio: float = MIN_RATIO) -> DataFrame:
    """``docs`` with ``[SECRET]`` in place of the values that ``scan`` finds and ``n_chars``, if there, counted
    anew. One kind after the other; a text is put together again from its matches and the gaps."""
    model = train(docs) if model is None else model
    columns = docs.columns
    keep = [F.col(c).alias(f"_{i}") for i, c in enumerate(columns) if c != "text"]
    table = docs.select("text", *keep)
    for name, pattern, group, least in (
        ("assign", ASSIGN, 2, VALUE_LENGTH), ("access", ACCESS, 0, 0), ("hex", HEX, 0, 0), ("model", CANDIDATE, 0, 0),
        ("part", PART, 0, 0),
    ):
        table = _split(table, pattern, group)
        secret = lambda v: (F.length(v) >= least) if name not in ("model", "part") else _is_random(v, model, min_ratio)  # noqa: E731, B023
        new = F.zip_with(
            F.col("hits"), F.col("values"),
            lambda h, v: F.when(secret(v), F.concat(F.left(h, F.length(h) - F.length(v)), F.lit(MARK))).otherwise(h),  # noqa: B023
        )
        joined = F.array_join(F.flatten(F.zip_with(F.col("gaps"), new, lambda g, h: F.array(g, F.coalesce(h, F.lit(""))))), "")
        table = table.withColumn("text", F.when(F.size("hits") > 0, joined).otherwise(F.col("text"))).drop("hits", "gaps", "values")
    back = {c: F.col(f"_{i}") for i, c in enumerate(columns) if c != "text"}
    if "n_chars" in back:
        kind = docs.schema["n_chars"].dataType
        back["n_chars"] = F.when(F.col("text").isNull(), back["n_chars"]).otherwise(F.length("text").cast(kind))
    return table.select(*(F.col("text") if c == "text" else back[c].alias(c) for c in columns))
