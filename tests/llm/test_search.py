"""Nearest neighbours, ranked search and phrases: brute force, recall, defined cases."""

import collections
import math
import random
import re

import numpy as np
import pytest

from synchrony.llm import hamming, lexical, phrases
from synchrony.llm.common import table

from ..oracle import connect
from .test_llm import FOLDER, documents


def brute_nearest(rows, k, every):
    known = {(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    score = lambda a, b: math.fsum(x * y for x, y in zip(a, b))
    out = {}
    for q, v in known:
        if q % every == 0:
            out.setdefault(q, []).extend((score(v, w), i) for i, w in known if i != q)
    return {q: sorted(x, key=lambda y: (-y[0], y[1]))[:k] for q, x in out.items()}


def found_by(df):
    out = collections.defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out[r.query_id].append((r.score, r.vec_id))
        assert r["rank"] == len(out[r.query_id])
    return dict(out)


def recall_of(got, want):
    hit = sum(len({i for _, i in got.get(q, [])} & {i for _, i in x}) for q, x in want.items())
    return hit / sum(map(len, want.values()))


@pytest.mark.parametrize("folder", [FOLDER, "/root/testdata/sf0.1"])
def test_recall_on_given_vectors(spark, folder):
    vectors = table(spark, folder, "embeddings")
    rows = [(r.vec_id, r.embedding) for r in vectors.collect()]
    ids, m = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    got = found_by(hamming.op11_hamming_search(vectors))
    hits = 0
    for q in ids[ids % 20 == 0]:
        scores = m @ m[ids == q][0]
        scores[ids == q] = -9
        best = set(ids[np.argsort(-scores)[:20]].tolist())
        assert len(got[q]) == 20 and all(abs(s - scores[ids == i][0]) < 1e-12 for s, i in got[q])
        hits += len(best & {i for _, i in got[q]})
    assert len(got) == sum(ids % 20 == 0) and hits >= 0.9 * 20 * len(got)


VECTORS = "vec_id long, embedding array<float>, label int, v string, shard int, score double, rank int"


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 2, 0.5, 9) for i, v in rows], VECTORS)


def test_nearest_defined_cases(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.5, 0.5]), (4, None), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [0.0, 0.0]), (8, []), (20, [2.0]), (20, [2.0]), (40, [-1.0, 3.0, 1.0]), (None, [1.0, 1.0]), (9, [-5.0, 1.0])]
    got = found_by(hamming.op11_hamming_search(vectors_of(spark, rows)))
    assert got == brute_nearest(rows, 20, 20)
    assert hamming.op11_hamming_search(vectors_of(spark, rows).limit(0)).count() == 0
    assert hamming.op11_hamming_search(vectors_of(spark, [(4, None)])).count() == 0


def test_nearest_finds_k_among_copies_and_outliers(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [1.0, *([0.0] * 15)]) for i in range(60)] + [(100 + i, rng.normal(size=16).astype(np.float32).tolist()) for i in range(300)] + [(500, [1000.0] * 16)]
    got, want = found_by(hamming.op11_hamming_search(vectors_of(spark, rows), k=7)), brute_nearest(rows, 7, 20)
    assert {q: len(x) for q, x in got.items()} == {q: len(x) for q, x in want.items()}
    assert recall_of(got, want) >= 0.9


def test_every_code_within_the_radius_is_retrieved():
    rng = np.random.default_rng(3)
    codes = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    codes[:1000] = codes[0] ^ (np.uint64(1) << rng.integers(0, 64, 1000).astype(np.uint64))
    shard = hamming.Shard(np.arange(3000), codes, None, *hamming.posted(codes))
    for code in codes[[0, 5, 2000]]:
        for radius in (0, 1, 2, 3, 4, 7, 13, 26, 30, 40, 63, 64):
            assert shard.within(code, radius).tolist() == np.flatnonzero(np.bitwise_count(codes ^ code) <= radius).tolist()


def test_index_opens_again(spark, tmp_path):
    vectors = table(spark, FOLDER, "embeddings").select("vec_id", hamming.usable(hamming.F.col("embedding")).alias("v"))
    hamming.HammingIndex.build(vectors, str(tmp_path / "index"), shard=256)
    index = hamming.HammingIndex(spark, str(tmp_path / "index"))
    assert index.n_shards == 2 and sum(len(r.ids) for r in index.shards.collect()) == index.count == 500
    one = vectors.where("vec_id = 3")
    assert index.search(one, 600, 64).count() == 499
    assert index.nearest(one, 5).count() == 5


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_ranks(docs, items, k=10):
    bags = [(i, collections.Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    bags = [x for x in bags if x[1]]
    n, length = len(bags), sum(sum(b.values()) for _, b in bags)
    df = collections.Counter(t for _, b in bags for t in b)
    wanted = collections.defaultdict(collections.Counter)
    for item, text in set(items):
        wanted[item].update(TERM.findall((text or "").translate(LOWER)))
    out = set()
    for item, terms in wanted.items():
        scored = []
        for i, b in bags:
            m = 25 + (75 * sum(b.values()) * n) // length
            score = sum(many * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * b[t]) // (1000 * b[t] + 8 * m)) for t, many in terms.items() if t in b)
            if score > 0:
                scored.append((-score, i is None, i))
        out |= {(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scored)[:k])}
    return out


def benchmark(spark, rows):
    return spark.createDataFrame([(i, t, 1, "b", 5) for i, t in rows], "item_id long, text string, doc_id long, bag string, score int")


@pytest.mark.parametrize("block", [lexical.BLOCK, 7])
def test_ranks_by_brute_force(spark, block):
    random.seed(4)
    word = lambda: random.choice(["alpha", "Beta", "ÄRGER", "ärger", "x1", "y", "zeta", "omega", "tau"])
    docs = [(i, " ".join(word() for _ in range(random.randint(0, 7)))) for i in range(300)]
    docs += [(i, "same old copy: alpha, beta") for i in range(900, 940)] + [(905, "same old copy: alpha, beta"), (None, "zeta"), (None, "same old copy: alpha, beta"), (3000, None), (3001, "long alpha " * 30_000)]
    items = [(1, "alpha beta"), (1, "alpha beta"), (1, "tau"), (2, "ALPHA alpha; omega?"), (3, None), (4, "unheard of"), (None, "zeta"), (5, "old copy"), (6, "y y y x1")]
    got = lexical.ranked(documents(spark, docs), benchmark(spark, items), block=block).collect()
    assert {(r.item_id, r["rank"], r.doc_id, r.score) for r in got} == brute_ranks(docs, items)
    assert len(got) == len(brute_ranks(docs, items))


def test_ranks_of_empty_tables(spark):
    docs, items = documents(spark, [(1, "a"), (2, None)]), benchmark(spark, [(1, "a"), (2, None)])
    assert lexical.op12_lexical_search(docs.limit(0), items).count() == 0
    assert lexical.op12_lexical_search(docs, items.limit(0)).count() == 0
    assert lexical.op12_lexical_search(docs.where("doc_id = 2"), items).count() == 0


def brute_phrases(docs, longest, least, top, covered):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in docs:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        often = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        hidden = {p[i:j] for p, a in often.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and 100 * a >= covered * counts[p[i:j]]}
        rows = []
        for p, a in often.items():
            if p not in hidden:
                score, _, l, r = min(((1000 * a * n[lang]) // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def phrase_docs(spark, docs):
    return spark.createDataFrame([(i, t, lang, 1, "p", "w", 3) for i, (lang, t) in enumerate(docs)], "doc_id long, text string, lang string, n long, phrase string, words string, fp int")


@pytest.mark.parametrize("setting", [dict(longest=5, least=4, top=2000, covered=100), dict(longest=4, least=3, top=7, covered=60), dict(longest=2, least=3, top=50, covered=100), dict(longest=7, least=4, top=500, covered=90)])
def test_phrases_by_brute_force(spark, setting):
    random.seed(8)
    word = lambda: random.choice(["Of", "the", "new", "york", "city", "a", "a", "ÉTÉ", "été", "x\x0by", "don't"])
    docs = [(random.choice(["en", "de", None, "und"]), "".join(word() + random.choice([" ", " ", " ", "  \t", ". ", "\n", "!", ",;"]) for _ in range(random.randint(0, 40)))) for _ in range(120)]
    docs += [("en", None), ("en", ""), ("fr", " \n "), ("fr", "one"), ("en", "in the year of the lord " * 300), ("en", "z" * 50_000)] + [("de", "genau gleicher text hier und noch mehr.")] * 9
    got = phrases.collocations(phrase_docs(spark, docs), **setting).collect()
    assert sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in got) == brute_phrases(docs, **setting)


def test_phrases_of_empty_table_and_huge_counts(spark):
    docs = phrase_docs(spark, [("en", "a b")])
    assert phrases.op13_phrase_mining(docs.limit(0)).count() == 0
    assert phrases.op13_phrase_mining(docs).count() == 0


def test_fingerprints_that_meet_are_told_apart():
    runs = phrases.Runs([b"a b c. a b d. c a b"], ["en"])
    at = runs.at(2)
    assert runs.verified(at, np.zeros(len(at), np.uint64), 2) == runs.verified(at, runs.prints(at, 2), 2) == {("en", "a b"): 3, ("en", "b c"): 1, ("en", "b d"): 1, ("en", "c a"): 1}


def test_small_portions_and_flushes_change_nothing(spark, monkeypatch):
    docs = [("en", "one two three four five six. " * 3 + "x y")] * 20 + [("de", "eins zwei drei " * 5)] * 20
    source = phrase_docs(spark, docs)
    whole = phrases.collocations(source, least=4).collect()

    def tiny(self, batches, count=phrases.Pass.count):
        phrases.KEPT_RUNS, phrases.KEPT_PHRASES, phrases.TOGETHER = 50, 3, 100
        yield from count(self, batches)

    monkeypatch.setattr(phrases.Pass, "count", tiny)
    assert phrases.collocations(source, least=4).collect() == whole


def test_phrases_of_given_documents(spark):
    docs = table(spark, FOLDER, "documents")
    rows = connect(FOLDER).execute("SELECT lang, text FROM documents").fetchall()
    got = phrases.collocations(docs, least=20).collect()
    assert sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in got) == brute_phrases(rows, 5, 20, 2000, 100)
