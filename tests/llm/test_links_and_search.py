"""N-gram joins, ranked search and token alignment against brute force, and their odd rows."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from hearthline.llm import pair_alignment, prefix_trie, ranked_search
from hearthline.llm.token_count import byte_letters

DOCS = "doc_id long, text string, lang string, source string, n_chars long, f string, score string, rank string, slot string, a string"
RANKS, PIECES = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model")


def rows_of(texts, ids=None):
    return [(i, t, None, "s", None, "clash", None, "clash", None, "clash") for i, t in zip(ids or range(len(texts)), texts)]


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


# n-gram joins


def ngram_set(text, size):
    words = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))) if len(words) >= size else frozenset([tuple(words)])


def brute_components(texts, size, percent):
    """For each row, the rows reachable over links."""
    sets, leader = [ngram_set(t, size) for t in texts], list(range(len(texts)))

    def top(x):
        while leader[x] != x:
            x = leader[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * shared >= percent * (len(sets[i]) + len(sets[j]) - shared):
                leader[top(i)] = top(j)
    return sets, [top(i) for i in range(len(sets))]


def related_texts(seed, families=14, words=300):
    """Families of texts with few or many changed words, passages that families share, copies, short and odd texts."""
    rng = random.Random(seed)
    fresh = lambda k: [f"w{rng.randint(0, words)}" for _ in range(k)]
    passage, out = fresh(30), []
    for f in range(families):
        base = fresh(rng.choice([6, 20, 60, 150]))
        if f % 3 == 0:
            base = base[: len(base) // 2] + passage + base[len(base) // 2 :]
        for _ in range(rng.randint(1, 9)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(copy) // 25))):
                copy[rng.randrange(len(copy))] = fresh(1)[0]
            out.append(" ".join(copy))
    return out + out[:4] + [None, "", " \t\n", "one", "ONE", "one two", "x y z", "the " * 40, " ".join(fresh(4000))]


@pytest.mark.parametrize("seed, size, percent", [(1, 4, 85), (2, 4, 85), (3, 2, 60)])
def test_components_equal_brute_force(spark, seed, size, percent):
    texts = related_texts(seed)
    sets, top = brute_components(texts, size, percent)
    least = defaultdict(lambda: 1 << 40)
    for i, t in enumerate(top):
        least[t] = min(least[t], i)
    got = {r["doc_id"]: r for r in prefix_trie.linked_texts(spark.createDataFrame(rows_of(texts), DOCS).repartition(5), size, percent).collect()}
    assert [(got[i]["n_shingles"], got[i]["component_id"]) for i in range(len(texts))] == [(len(sets[i]), least[top[i]]) for i in range(len(texts))]
    assert len(set(top)) < len(texts) - 20


def test_blocks_of_few_sets(spark, monkeypatch):
    """Groups cut into many blocks give the same components."""
    texts = related_texts(4)
    df = spark.createDataFrame(rows_of(texts), DOCS)
    want = sorted(map(tuple, prefix_trie.linked_texts(df, 4, 85).collect()))
    monkeypatch.setattr(prefix_trie, "BLOCK", 100)
    monkeypatch.setattr(prefix_trie, "BLOCK_SETS", 2)
    assert sorted(map(tuple, prefix_trie.linked_texts(df, 4, 85).collect())) == want


def test_odd_rows_of_joins(spark, none):
    """Rows without or with equal doc_ids are judged each by its own text."""
    long_text = " ".join(f"t{k}" for k in range(50))
    rows = rows_of([long_text, long_text + " end", "alone", long_text, None, None], [7, 3, 7, None, None, 9])
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in prefix_trie.linked_texts(spark.createDataFrame(rows, DOCS), 4, 85).collect()), key=str)
    assert got == sorted([(7, 47, 3), (3, 48, 3), (7, 1, 7), (None, 47, 3), (None, 0, None), (9, 0, 9)], key=str)
    assert prefix_trie.linked_texts(none, 4, 85).count() == 0
    assert prefix_trie.linked_texts(spark.createDataFrame(rows_of([None, ""]), DOCS), 4, 85).count() == 2


@pytest.mark.parametrize("seed", range(6))
def test_trie_finds_all_links(seed):
    rng = np.random.default_rng(seed)

    def sets(count):
        out = []
        for _ in range(count):
            base = out[rng.integers(len(out))] if out and rng.random() < 0.7 else rng.choice(400, rng.integers(1, 120), replace=False)
            keep = base[rng.random(len(base)) > 0.04]
            out.append(np.unique(np.concatenate([keep, rng.choice(400, rng.integers(0, 4))])))
        out = [s if len(s) else np.array([1]) for s in out]
        return np.concatenate(out).astype(np.uint64), np.concatenate([[0], np.cumsum([len(s) for s in out])]), np.array([len(s) + int(rng.integers(0, 3)) for s in out])

    (ka, ba, na), (kb, bb, nb) = sets(60), sets(50)
    for percent in (50, 85, 100):
        x, y = prefix_trie.Trie(kb, bb, nb).links(ka, ba, na, percent)
        want = set()
        for i in range(len(na)):
            for j in range(len(nb)):
                shared = len(set(ka[ba[i] : ba[i + 1]].tolist()) & set(kb[bb[j] : bb[j + 1]].tolist()))
                if 100 * shared >= percent * (int(na[i]) + int(nb[j]) - shared):
                    want.add((i, j))
        assert set(zip(x.tolist(), y.tolist())) == want and len(x) == len(want)


def test_forest_joins_the_same_nodes():
    rng = random.Random(3)
    edges = [[rng.randrange(40), rng.randrange(40)] for _ in range(60)]

    def groups(pairs):
        leader = list(range(40))
        for a, b in pairs:
            leader = [leader[b] if x == leader[a] else x for x in leader]
        return [frozenset(i for i in range(40) if leader[i] == x) for x in leader]

    kept = prefix_trie.forest(edges)
    assert groups(kept) == groups(edges) and len(kept) == 40 - len(set(groups(edges))) and prefix_trie.forest([]) == []


def test_prefixes_share_an_ngram():
    """Keys ascend in one order for all sets, and prefixes of linked sets meet in it."""
    rng = np.random.default_rng(9)
    universe = rng.integers(0, 1 << 63, 300, dtype=np.uint64) * np.uint64(2)
    held = {int(t): int(rng.integers(2, 5000)) for t in universe[prefix_trie.counted(universe)]}
    for _ in range(200):
        a = rng.choice(universe, 60, replace=False)
        b = np.unique(np.concatenate([a[rng.random(60) > 0.06], rng.choice(universe, 2)]))
        shared = len(set(a.tolist()) & set(b.tolist()))
        if 100 * shared < 85 * (len(a) + len(b) - shared):
            continue
        keys = [prefix_trie.order_keys(s, s[prefix_trie.counted(s)], np.array([held[int(t)] for t in s[prefix_trie.counted(s)]])) for s in (a, b)]
        take = [len(s) - math.ceil(len(s) * 85 / 100) + 1 for s in (a, b)]
        assert set(keys[0][: take[0]].tolist()) & set(keys[1][: take[1]].tolist()) and len(keys[0]) == len(a)


# ranked search


def brute_ranks(docs, items, k):
    terms = lambda t: re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    held = [(i, Counter(terms(t))) for i, t in docs]
    n, total = sum(1 for _, c in held if c), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        asked = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) for t in set(terms(text))}
        scores = []
        for i, c in held:
            m = 50 + 50 * sum(c.values()) * n // max(total, 1)
            score = sum(w * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t, w in asked.items() if c[t])
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, s[3], -s[0]) for r, s in enumerate(sorted(scores)[:k])]
    return out


def test_ranks_equal_brute_force(spark, none):
    rng = random.Random(8)
    words = ["Alpha", "beta", "Gamma's", "été", "ÉTÉ", "x-y", "42", "日本", "the", "THE", "of", "q_r", "🙂"]
    docs = [(i, " ".join(rng.choices(words, k=rng.choice([1, 2, 5, 30, 300])))) for i in range(150)]
    docs += [(200, None), (201, ""), (202, "-- !!"), (203, docs[3][1]), (203, docs[3][1]), (None, docs[3][1]), (204, "the " * 20_000)]
    items = [(1, "alpha BETA beta"), (2, "x y the"), (3, None), (4, ""), (5, "unknown"), (6, "🙂 été 42"), (6, "日本"), (6, "日本"), (None, "q"), (7, " ".join(words))]
    df = spark.createDataFrame(rows_of([t for _, t in docs], [i for i, _ in docs]), DOCS).repartition(4)
    asked = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    want = sorted(brute_ranks(docs, list(dict.fromkeys(items)), 7), key=str)
    for most in (ranked_search.TERMS, 2):
        got = sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in ranked_search.ranked(df, asked, 7, most).collect()), key=str)
        assert got == want
    assert ranked_search.ranked(none, asked).count() == 0 == ranked_search.ranked(df, asked.limit(0)).count()


def test_relative_lengths_have_no_bound():
    assert ranked_search.relative_lengths(np.array([3, 10**9, 3]), 10**12, 10**13).tolist() == [50 + 15, 50 + 5 * 10**9, 50 + 15]


def test_few_groups_are_evaluated(monkeypatch):
    """Once good documents are known, documents with common terms only are left out."""
    rng = np.random.default_rng(2)
    size, documents = 30, 2000
    times = (rng.random((size, documents)) < np.where(np.arange(size) < 25, 0.01, 0.8)[:, None]).astype(int)
    text, place = np.nonzero(times.T)
    run = ranked_search.Run(np.arange(documents), np.full(documents, 100), text, place, times.T[text, place], size)
    weights = np.where(np.arange(size) < 25, 4000, 100)
    best, seen = ranked_search.Best(10), []
    plain = best.offer
    monkeypatch.setattr(best, "offer", lambda scores, ids: (seen.append(len(ids)), plain(scores, ids)))
    run.rank(np.arange(size), weights, best)
    scores = (weights[:, None] * ranked_search.gain(times, np.array(100))).sum(axis=0)
    order = np.lexsort((np.arange(documents), -scores))[:10]
    assert best.ids.tolist() == order.tolist() and best.scores.tolist() == scores[order].tolist() and sum(seen) < documents / 4


# token alignment


def aligned(texts):
    """Rows by plain loops over the libraries' tokens."""
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b, letters = sentencepiece.SentencePieceProcessor(model_file=PIECES), byte_letters()
    spelled_a = {i: bytes(letters[c] for c in s) for s, i in a.get_vocab().items() if s != "<|endoftext|>"}
    spelled_b = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", b.id_to_piece(i)) else b.id_to_piece(i).replace("▁", " ").encode()
    known, held, best = [], Counter(), Counter()
    for text in texts:
        ids = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ((), ())
        spelled = [spelled_a[i] for i in ids[0]], [spelled_b(i) for i in ids[1]]
        if not text or any(b"".join(s) != (" " + text).encode() for s in spelled):
            known.append(([], [], [], Counter()))
            continue
        ends = [np.cumsum([len(t) for t in s]).tolist() for s in spelled]
        groups, i, j = [], 0, 0
        for end in sorted(set(ends[0]) & set(ends[1])):
            k, m = ends[0].index(end) + 1, ends[1].index(end) + 1
            groups.append((ids[0][i:k], ids[1][j:m]))
            i, j = k, m
        links = Counter((x, y) for g in groups for x in g[0] for y in g[1])
        held.update(links.keys())
        known.append((*ids, groups, links))
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    out = []
    for ids_a, ids_b, groups, links in known:
        written = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)
        digest = hashlib.sha256(written.encode()).hexdigest() if groups else ""
        out.append((len(ids_a), len(ids_b), len(groups), sum(links.values()), sum(n for p, n in links.items() if held[p] == best[p[0]]), sum(n * held[p] for p, n in links.items()), digest))
    return out


ODD = [None, "", " ", "  a  b ", "x▁y", "日本語テキスト🙂🙂", "a\0b", "​éé ﬁ", "<|endoftext|> hi </s><s>", "\n\n\t x" * 3, " " * 3000 + "x" * 2000, "one two", "one two", "the " * 5000 + "end"]


def test_alignment_equals_plain_loops(spark, folder, none):
    given = [r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").orderBy("doc_id").collect()]
    texts = ODD + given
    df = spark.createDataFrame(rows_of(texts), DOCS).repartition(6, "doc_id")
    got = {r["doc_id"]: tuple(r[c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) for r in pair_alignment.align_tokens(df, RANKS, public_tokenizers.PATTERN, PIECES).collect()}
    assert [got[i] for i in range(len(texts))] == aligned(texts)
    assert got[0] == got[1] == got[4] == (0, 0, 0, 0, 0, 0, "")
    assert pair_alignment.align_tokens(none, RANKS, public_tokenizers.PATTERN, PIECES).count() == 0
    assert pair_alignment.align_tokens(df.where("doc_id < 2"), RANKS, public_tokenizers.PATTERN, PIECES).where("n_links = 0").count() == 2


def test_link_counts_of_pairs(spark):
    """Multiplicity planes add up to links, bitmaps to documents."""
    texts = ["the the the cat", "the cat", "a cat", "cat cat the"]
    both = pair_alignment.encoded(spark.createDataFrame(rows_of(texts), DOCS).repartition(2), RANKS, public_tokenizers.PATTERN, PIECES)
    pairs = pair_alignment.pair_counts(both.where("slot is null"))
    ranks = pair_alignment.read_ranks(RANKS)
    assert {r["a"]: (r["count"], r["links"], r["best"]) for r in pairs.collect()} == {ranks[b" the"]: (3, 5, True), ranks[b" cat"]: (4, 5, True), ranks[b" a"]: (1, 1, True)}


@pytest.mark.parametrize("share", [0.001, 0.05, 0.07, 0.9])
def test_bitmaps_round_trip(share):
    rng = np.random.default_rng(1)
    runs = [np.flatnonzero(rng.random(pair_alignment.DOCUMENTS) < s) for s in (share, 0.002, 0.3, share)]
    sizes = np.array([len(r) for r in runs])
    made = pair_alignment.bitmaps(np.concatenate(runs).astype("<u2"), np.cumsum(sizes) - sizes, sizes).to_pylist()
    assert [pair_alignment.members(m).tolist() for m in made] == [r.tolist() for r in runs] and max(map(len, made)) == pair_alignment.DENSE


def test_long_runs_are_encoded(spark):
    """A long text without blanks, and a long run of blanks."""
    rng = random.Random(4)
    texts = ["".join(rng.choices("abcdefghij", k=60_000)), "y" + " " * 60_000 + "z"]
    got = [tuple(r)[1:] for r in pair_alignment.align_tokens(spark.createDataFrame(rows_of(texts), DOCS), RANKS, public_tokenizers.PATTERN, PIECES).orderBy("doc_id").collect()]
    assert got == aligned(texts)


def test_repeated_rows_of_alignment(spark):
    df = spark.createDataFrame(rows_of(["some words here"] * 3, [1, 1, None]), DOCS)
    assert {r["count_sum"] for r in pair_alignment.align_tokens(df, RANKS, public_tokenizers.PATTERN, PIECES).collect()} == {9}
    assert df.agg(F.count("*")).first()[0] == 3
