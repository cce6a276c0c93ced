"""Token alignment, collocations and exact dedup against plain versions."""

import hashlib
import os
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from brute import AWKWARD, LONG, awkward

from siftline.llm import alignment, exact, phrases
from siftline.llm.known import Known, distinct, gathered, packed

SMALL = "/root/testdata/sf0.001"
ODD = (
    "it's| foo|<|endoftext|>|a.b| x|  |   y|é| é|É| Σ|　|  |  z|\n|\t| \n |漢字| 漢字|123| 1|...|▁| ▁b|<s>|</s>| <unk>"
    "|<0x0A>|😀| 😀|́| ́|\x00| \x85| \x1c|'ll| 's| ç|​| word"
).split("|")


def documents(spark, texts, langs=None):
    rows = [(k, t, langs[k] if langs else "en") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def small_texts():
    return pq.read_table(f"{SMALL}/documents.parquet", columns=["text"])["text"].to_pylist()


# Alignment

def plain_alignment(rows):
    """Whole texts by the libraries, groups by common ends, links by comparing all tokens near."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(x): x for x in plain}
    letters |= {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in plain)}

    def a_bytes(k):
        return bytes(letters[c] for c in a.id_to_token(k))

    def b_bytes(k):
        p = b.id_to_piece(k)
        return bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode()

    found, counts = [], Counter()
    for doc_id, text in rows:
        ids = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        spelt = [[a_bytes(k) for k in ids[0]], [b_bytes(k) for k in ids[1]]]
        if text and not b"".join(spelt[0]) == b"".join(spelt[1]) == (" " + text).encode():
            ids, spelt = ([], []), [[], []]
        ends = [np.cumsum([len(x) for x in s]).tolist() for s in spelt]
        groups, links, i, j = [], [], 0, 0
        common = set(ends[0]) & set(ends[1])
        starts = [[0, *e[:-1]] for e in ends]
        for x in range(len(ids[0])):
            while j < len(ids[1]) and ends[1][j] <= starts[0][x]:
                j += 1
            for y in range(j, len(ids[1])):
                if starts[1][y] >= ends[0][x]:
                    break
                links.append((ids[0][x], ids[1][y]))
        i = j = 0
        for cut in sorted(common):
            x, y = ends[0].index(cut, i) + 1, ends[1].index(cut, j) + 1
            groups.append(",".join(map(str, ids[0][i:x])) + "|" + ",".join(map(str, ids[1][j:y])))
            i, j = x, y
        counts.update(links)
        found.append((doc_id, ids, groups, links))
    best = defaultdict(int)
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    out = []
    for doc_id, ids, groups, links in found:
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        n_best = sum(counts[x] == best[x[1]] for x in links)
        out.append((doc_id, len(ids[0]), len(ids[1]), len(groups), len(links), n_best, sum(counts[x] for x in links), digest))
    return sorted(out, key=repr)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def told(table, columns=COLUMNS):
    return sorted((tuple(r[c] for c in columns) for r in table.collect()), key=repr)


def test_alignment_equals_plain_one(spark):
    rng = random.Random(3)
    texts = [None, "", " ", *small_texts()]
    texts += ["".join(rng.choice(ODD) for _ in range(rng.randint(1, 25))) for _ in range(400)]
    docs = documents(spark, texts).repartition(5)
    assert told(alignment.align_tokens(docs)) == plain_alignment(list(enumerate(texts)))


def test_alignment_of_awkward_rows_and_none(spark):
    want = plain_alignment([(r[0], r[1]) for r in AWKWARD])
    assert told(alignment.align_tokens(awkward(spark))) == want
    assert alignment.align_tokens(awkward(spark).limit(0)).collect() == []


def test_alignment_in_many_slices(spark, monkeypatch):
    texts = small_texts()[:60]
    docs = documents(spark, texts).coalesce(1)
    monkeypatch.setattr(alignment, "SLICE", 4_000)
    assert told(alignment.align_tokens(docs)) == plain_alignment(list(enumerate(texts)))


def test_coalesce_of_any_intervals():
    rng = np.random.default_rng(4)
    for _ in range(50):
        a, b = (np.unique(rng.integers(1, 60, rng.integers(1, 20))) for _ in range(2))
        end = max(a[-1], b[-1])
        a, b = (np.unique(np.append(x, end)) for x in (a, b))
        a0, b0 = np.append(0, a[:-1]), np.append(0, b[:-1])
        ga, gb, left, right = alignment.coalesce(a, a0, b, b0)
        common = np.intersect1d(a, b)
        assert ga.tolist() == np.searchsorted(common, a).tolist()
        assert gb.tolist() == np.searchsorted(common, b).tolist()
        want = [(x, y) for x in range(len(a)) for y in range(len(b)) if a0[x] < b[y] and b0[y] < a[x]]
        assert list(zip(left.tolist(), right.tolist())) == want


def test_known_words_stay_within_memory():
    asked = Counter()

    def encode(words):
        asked.update(words)
        return [packed([len(w)]) for w in words]

    known = Known(encode, memory=20_000)
    for k in range(300):
        words = [b"often", b"%d" % k, b"x" * (500 + k)]
        ids, starts = known.ids(words)
        assert ids.tolist() == [len(w) for w in words] and starts.tolist() == [0, 1, 2, 3]
    assert asked[b"often"] == 1 and asked[b"x" * 500] == 1
    assert sum(len(w) + len(x) + 180 for g in (known.young, known.old) for w, x in g.items()) < 21_000
    assert not any(len(w) > 64 for w in [*known.young, *known.old])


def test_distinct_stretches():
    data = np.frombuffer(b"ab cd ab", np.uint8)
    words, which = distinct(data, np.array([0, 3, 6, 7]), np.array([2, 5, 7, 8]))
    assert [words[k] for k in which] == [b"ab", b"cd", b"a", b"b"]
    places, before = gathered(np.array([0, 2, 2, 5]), np.array([2, 0, 1]))
    assert places.tolist() == [2, 3, 4, 0, 1] and before.tolist() == [0, 3, 5, 5]


# Collocations

def plain_collocations(rows, longest=3, least=10, covered=50, top=2000):
    f, n = defaultdict(Counter), Counter()
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for lang, text in rows:
        lang = lang if lang is not None else "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(table)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, count in f.items():
        candidates = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        scored = []
        for p, a in candidates.items():
            cuts = [(1_000_000 * a * a // (count[p[:k]] * count[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            scored.append((-score, -a, " ".join(p).encode(), a, count[p[:k]], count[p[k:]], p))
        longer = Counter()
        for p, a in candidates.items():
            for m in range(2, len(p)):
                for at in range(len(p) - m + 1):
                    longer[p[at : at + m]] = max(longer[p[at : at + m]], a)
        kept = sorted(x for x in scored if not 100 * longer[x[-1]] >= covered * x[3])
        for rank, (score, _, phrase, a, l, r, _) in enumerate(kept[:top], 1):
            out.append((lang, rank, phrase.decode(), a, l, r, n[lang], -score))
    return sorted(out, key=repr)


PHRASES = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def chatter(seed, n=600):
    rng = random.Random(seed)
    words = ["New", "york", "city", "the", "of", "a", "x", "é", "É", "1", "a-b", "the.", "of,", "\x01z", "to be", "\n", "\t", "Q" * 300]
    return ["".join(rng.choice(words) + rng.choice([" ", "  ", "\t", " ", "; "]) for _ in range(rng.randint(0, 60))) for _ in range(n)]


@pytest.mark.parametrize("longest,held", [(3, 3_000_000), (3, 400), (2, 400), (4, 1_000)])
def test_collocations_equal_plain_ones(spark, longest, held):
    texts = chatter(5) + ["New York City"] * 40 + [None, ""]
    langs = [("en", "fr", None)[k % 3] for k in range(len(texts))]
    got = told(phrases.collocations(documents(spark, texts, langs).repartition(6), longest=longest, held=held), PHRASES)
    want = plain_collocations(list(zip(langs, texts)), longest=longest)
    assert got == want and len(want) > 50


def test_collocations_of_awkward_rows_and_none(spark):
    got = told(phrases.collocations(awkward(spark), least=2), PHRASES)
    assert got == plain_collocations([(r[2], r[1]) for r in AWKWARD], least=2) and got
    assert phrases.collocations(awkward(spark).limit(0)).collect() == []


def test_collocations_top_and_ties(spark):
    texts = [f"p{k} q{k}. " * 12 for k in range(60)]
    got = told(phrases.collocations(documents(spark, texts), top=7), PHRASES)
    assert got == plain_collocations([("en", t) for t in texts], top=7) and len(got) == 7


def test_products_beyond_64_bits(spark, monkeypatch):
    f = 4_000_000_000
    rows = [("en", "", 0, f), ("en", "a", 1, f), ("en", "b", 1, f + 1), ("en", "a b", 2, f - 1)]
    counts = spark.createDataFrame(rows, "lang string, phrase string, size int, f long")
    monkeypatch.setattr(phrases, "phrase_counts", lambda *_: counts)
    row = phrases.collocations(documents(spark, ["x"])).first()
    assert row["score"] == 1_000_000 * (f - 1) ** 2 // (f * (f + 1))


def test_runs_merge_under_a_small_limit():
    import pyarrow as pa

    rng = random.Random(6)
    want, rows = Counter(), []
    for _ in range(60):
        c = Counter(f"{rng.randint(0, 40)} {rng.randint(0, 3)}" for _ in range(30))
        want.update(c)
        run = sorted(c)
        rows.append({"part": 0, "lang": "en", "phrases": "".join(p + "\n" for p in run).encode(), "counts": [c[x] for x in run]})
    batches = [pa.RecordBatch.from_pylist([r], schema=phrases.RUNS) for r in rows]
    got = [r for b in phrases._merge(3, 500)(batches) for r in b.to_pylist()]
    assert {r["phrase"]: r["f"] for r in got if r["size"]} == {p: n for p, n in want.items() if n >= 3}


def test_trie_counts_and_bursts(monkeypatch):
    monkeypatch.setattr(phrases, "BURST", 64)
    rng = np.random.default_rng(7)
    trie, want = phrases.Trie(14, 3), Counter()
    for _ in range(30):
        keys, times = np.unique(rng.zipf(1.3, 500) % (1 << 42), return_counts=True)
        trie.add(keys, times)
        want.update(dict(zip(keys.tolist(), times.tolist())))
    assert trie.n == len(want)
    runs = trie.spill(len(want) // 2) + trie.spill(1 << 62)
    got = [(k, c) for keys, counts in runs for k, c in zip(keys.tolist(), counts.tolist())]
    assert len(got) == len(want) and dict(got) == dict(want) and trie.n == 0


# Exact dedup

def plain_exact(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[text or ""].append(doc_id)
    out = []
    for text, ids in groups.items():
        best = max((i for i in ids if i is not None), default=None)
        sha = hashlib.sha256(text.encode()).hexdigest()
        at = ids.index(best)
        out += [(i, best, len(ids), k == at, sha) for k, i in enumerate(ids)]
    return sorted(out, key=repr)


EXACT = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


@pytest.mark.parametrize("bucket,slice_", [(64 << 20, 16 << 20), (6_000, 1_000), (1_500, 300)])
def test_exact_duplicates_equal_plain_ones(spark, bucket, slice_):
    rng = random.Random(8)
    texts = ["hot"] * 150 + [f"text {rng.randint(0, 60)}" * rng.randint(1, 3) for _ in range(200)] + [None, "", "hot "]
    rng.shuffle(texts)
    ids = [rng.choice([None, *range(200)]) for _ in texts]
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").repartition(7)
    got = exact.exact_duplicates(docs, bucket_bytes=bucket, slice_bytes=slice_)
    assert told(got, EXACT) == plain_exact(list(zip(ids, texts)))


def test_exact_duplicates_of_awkward_rows_and_none(spark):
    rows = [*AWKWARD, (20, LONG, "en", "a"), (21, LONG + "  end", "en", "a")]
    assert told(exact.exact_duplicates(awkward(spark, rows)), EXACT) == plain_exact([r[:2] for r in rows])
    assert exact.exact_duplicates(awkward(spark).limit(0)).collect() == []
    left = exact.drop_exact_duplicates(awkward(spark, rows))
    assert left.columns == awkward(spark, rows).columns
    assert sorted(r["text"] or "" for r in left.collect()) == sorted({r[1] or "" for r in rows})


def test_a_table_compares_whole_texts():
    table = exact.Table(1_000)
    assert [table.place(5, t) for t in (b"a", b"b", b"a", b"")] == [0, 1, 0, 2]
    assert table.place(5, b"x" * 900) == -1 and table.place(5, b"b") == 1
    many = exact.Table(1 << 30)
    assert [many.place(k % 7, b"%d" % k) for k in range(5_000)] == list(range(5_000))
    assert [many.place(k % 7, b"%d" % k) for k in range(5_000)] == list(range(5_000))
    assert exact.Table(10).place(1, b"y" * 100) == 0


# The words of operator 9

def test_packing_ids_equal_the_library(monkeypatch):
    from siftline.llm import packing

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library, codec = Tokenizer.from_file(path), packing.Encoder(path)
    codec.known.room = 50_000
    rng = random.Random(10)
    parts = [*ODD, "FOO's", "<|ENDOFTEXT|>", "I'm.", "(x)", "\"'s", "Ḱ", "İ", "ΑΣ.", "öü.", "×.", "÷.", "Ö$", "ª!", "ÿ/x", "É-é", "ſ.", "ǅ", "İı."]
    parts += ["enzuä.'s", "a|.", "<|start", "of", "text|>", "<", ">", "x'LL", "a)b", "$$$", "Ab", "<|startoftext|>.", "字" * 300]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(3_000)] + [t or "" for t in small_texts()]
    for a in range(0, len(texts), 500):
        some = texts[a : a + 500]
        ids, starts = codec.encode([t.encode() for t in some])
        for text, x, y in zip(some, starts, starts[1:]):
            assert ids[x:y].tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)
    assert not any(len(w) > 64 for w in [*codec.known.young, *codec.known.old])
