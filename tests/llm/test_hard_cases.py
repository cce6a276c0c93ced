"""Cases beyond the table of awkward rows: many alphabets, repeated ids, mixed lengths, clashing columns."""

import brute
import numpy as np
from pyspark.sql import functions as F

from siftline.llm import common, language, mixing, profile, quality_rules, simhash, vectors
from siftline.llm.common import held_out


def greedy(codes, sample):
    """Phrases of a greedy parse of code points into the longest substrings of the sample, one letter at least; a letter that is not there is two."""
    text, sample, at, n = "".join(map(chr, codes)), "".join(map(chr, sample)), 0, 0
    while at < len(text):
        size = 1
        while at + size < len(text) and text[at : at + size + 1] in sample:
            size += 1
        n += 1 if text[at] in sample else 2
        at += size
    return n


def test_phrases_against_a_plain_parse():
    rng = np.random.default_rng(4)
    sample = tuple((f"l{k}", "".join(rng.choice(list("abcdé文字 "[k : k + 6]), 400))) for k in range(3))
    parse = language.Parser(sample)
    known = [[c if c < 0x110000 else 1 for c in parse._codes(t).tolist()] for _, t in sample]
    blocks = np.full((60, 64), language.PAD, np.int32)
    plain = []
    for row in blocks:
        codes = parse._codes("".join(rng.choice(list("abcdé文字xя "), rng.integers(1, 64))))[:64]
        row[: len(codes)] = codes
        plain.append([c if c < 0x110000 else 1 for c in codes.tolist()])
    want = [[greedy(p, s) for p in plain] for s in known]
    assert parse.phrases(blocks).tolist() == want


def test_languages_of_disjoint_scripts(spark):
    """Thousands of letters a language, and many languages: every letter keeps its own number."""
    rng = np.random.default_rng(5)
    for languages, letters in ((3, 3000), (60, 100)):
        text = lambda k, n: "".join(map(chr, 0x4E00 + k * letters + rng.integers(0, letters, n)))  # noqa: E731, B023
        rows = [(i, text(i % languages, 2000 if i < 20 * languages else 200), f"l{i % languages}") for i in range(30 * languages)]
        got = language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
        short = [r for r in got if r.doc_id >= 20 * languages]
        assert all(r.lang_pred == rows[r.doc_id][2] for r in short)


def test_learners_of_repeated_ids_and_long_texts(spark):
    """An id counts once, whatever number of rows it has in either table; long texts send an excerpt."""
    ids = [i for i in range(400) if spark.range(1).select(held_out(F.lit(i))).first()[0] is False][:100]
    hot = ids[0]
    docs = spark.range(5000).select(F.lit(hot).cast("long").alias("doc_id"), F.concat(F.lit("a "), F.col("id").cast("string")).alias("text"))
    docs = docs.union(spark.createDataFrame([(i, f"text {i}") for i in ids[1:]], "doc_id long, text string")).repartition(4)
    labels = spark.createDataFrame([(i, k % 2) for k, i in enumerate(ids)] + [(hot, 1)] * 50, "doc_id long, quality int")
    found = profile.labelled(docs, labels, "quality", 1000).collect()
    assert len(found) == len(ids) and sum(r.label for r in found) == 50
    assert sorted(r.text for r in profile.labelled(docs.repartition(3), labels, "quality", 1000).collect()) == sorted(r.text for r in found)
    long = spark.createDataFrame([(" ".join(map(str, range(200_000))), 1), ("short", 0), (None, 1), ("", 0)], "text string, label int")
    cut = {r.n: r.text for r in long.select(F.length("text").alias("n"), quality_rules._excerpt().alias("text")).collect()}
    assert cut[5] == "short" and cut[0] == "" and cut[None] is None
    assert sorted(len(t) for t in cut.values() if t)[-1] == quality_rules.EXCERPT


def test_vectors_are_their_own_nodes(spark):
    """One id on several vectors and labels joins no components; lengths may differ; labels of text."""
    rng = np.random.default_rng(6)
    x, y, z = rng.normal(size=(3, 64))
    near = lambda v: [float(a) for a in v + rng.normal(size=64) * 0.01]
    rows = [(5, near(x), "a"), (5, near(y), "b"), (2, near(x), "a"), (9, near(y), "b"), (7, near(z), "a"), (7, near(x), "b"), (1, near(z), "b")]
    got = brute.rows(vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string")), "vec_id", "n_links", "component_id")
    assert got == sorted([(5, 1, 2), (5, 1, 5), (2, 1, 2), (9, 1, 5), (7, 0, 7), (7, 0, 7), (1, 0, 1)])
    wide = [(k, [float(a) for a in rng.normal(size=(512, 520)[k % 2])], 1 - k % 2) for k in range(60)]
    wide += [(100 + k, [a * 2 for a in v], label) for k, v, label in wide]
    links = vectors.near_vectors(spark.createDataFrame(wide, "vec_id long, embedding array<float>, label int")).collect()
    assert all(r.n_links == 1 and r.component_id == r.vec_id % 100 for r in links)


def test_clashing_columns_keep_their_values(spark):
    names = ["_hash", "_kept_id", "_kept_hash", "hash", "kept_id", "kept_hash", "_key", "_copies", "_copy", "copy", "copies", "weight", "key", "passes", "cut", "Weight_"]
    rows = [(i, f"{'w ' * 30}{i * 7919} text {i} of its own", "en", f"s{i % 3}", *range(100 * i, 100 * i + len(names))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"{n} long" for n in names))
    for table in (simhash.drop_near_duplicates(docs), mixing.mixed(docs)):
        assert table.columns == docs.columns
        got = table.collect()
        assert got and all(tuple(r) == rows[r.doc_id] for r in got)


def test_hashes_of_crafted_words():
    """Words of two letters in an order that cancels out in polynomials, and words that differ in one far place."""
    word = b"a"
    while len(word) < 1024:
        word += word.translate(bytes.maketrans(b"ab", b"ba"))
    words = [word, word.translate(bytes.maketrans(b"ab", b"ba")), word[:-1] + b"c", b"c" + word[1:], b"a", b"b", b"ab", b"ba", b"a" * 64, b"a" * 65, b"\x00", b"\x00\x00"]
    data, starts = common.flat([b" ".join([*words, *words])])
    first, end = common.word_bounds(data, starts)
    got = common.word_hashes(data, first, end)
    assert len(set(got.tolist())) == len(words) and (got[: len(words)] == got[len(words) :]).all()
    for i, w in enumerate(words):
        data, starts = common.flat([w])
        assert common.word_hashes(data, *common.word_bounds(data, starts)).tolist() == [got[i]]
