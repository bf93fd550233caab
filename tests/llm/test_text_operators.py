"""The text operators against brute force, the libraries they follow, and odd rows."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from hearthline.llm import backoff_automaton, byte_bpe, decontamination, host_trust, near_copies, page_text, segment_search, shard_packing, token_count, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, words string, score string"
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def odd_texts():
    """Empty, null and blank texts, repeats, marks, other scripts, and a long one."""
    rng = random.Random(5)
    words = ["the", "The", "of", "ation", "réeux", "日本語", "x1", "don't", "🙂", "a,b", "<|endoftext|>"]
    texts = [None, "", "   \t\n", "one", "one two three", "A\u00a0b c", "the " * 9, "x" * 3000, "z\r\n\r\n  y", "<|endoftext|>mid<|endoftext|>"]
    texts += [" ".join(rng.choices(words, k=rng.randint(1, 60))) for _ in range(40)]
    texts += texts[10:14] + [texts[12] + " tail"]
    texts.append(" ".join(rng.choices(words, k=30_000)))
    return texts


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, None, "s", None, "clash", None) for i, t in enumerate(odd_texts())]
    return spark.createDataFrame(rows, DOCS).repartition(3, "doc_id")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def documents(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def texts_of(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


# byte-level BPE and token counts


@pytest.mark.parametrize("table", ["odd", "documents"])
def test_bpe_equals_the_library(request, table):
    df = request.getfixturevalue(table)
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})
    got = by_id(byte_bpe.digest_texts(df, RANKS, public_tokenizers.PATTERN))
    full = by_id(byte_bpe.encode_texts(df, RANKS, public_tokenizers.PATTERN))
    for key, text in texts_of(df).items():
        ids = encoding.encode_ordinary(text or "")
        assert got[key]["n_tokens"] == len(ids)
        assert got[key]["ids_sha256"] == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert got[key]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()
        assert full[key]["ids"] == ids and full[key]["round_trip"]


def test_transducer_on_random_pieces():
    rng = random.Random(3)
    ranks = byte_bpe.read_ranks(RANKS)
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    machine = byte_bpe.Transducer(ranks)
    for _ in range(1500):
        piece = "".join(rng.choice("aeinrstod hé日") for _ in range(rng.randint(1, 40))).encode()
        assert np.frombuffer(machine.encode(piece), dtype="<u4").tolist() == encoding._encode_single_piece(piece)


def test_utf8_stream_at_every_cut():
    data = "aé日🙂".encode() + b"\xff\xe6\x97" + "z".encode() + b"\xf0\x9f"
    for cut in range(len(data) + 1):
        state = byte_bpe.Utf8Stream()
        assert state.feed(data[:cut]) + state.feed(data[cut:]) + state.close() == data.decode("utf-8", "replace")
    state = byte_bpe.Utf8Stream()
    assert "".join(state.feed(data[i : i + 1]) for i in range(len(data))) + state.close() == data.decode("utf-8", "replace")


@pytest.mark.parametrize("table", ["odd", "documents"])
def test_token_counts_equal_the_library(request, table):
    df = request.getfixturevalue(table)
    file = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(file)
    got = by_id(token_count.count_tokens(df, file, public_tokenizers.PATTERN, limit=100))
    for key, text in texts_of(df).items():
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        assert (got[key]["n_tokens"], got[key]["n_bytes"], got[key]["over_limit"]) == (n, len((text or "").encode()), n > 100)


# near copies


def links_by_force(texts, size, percent):
    sets = {}
    for key, text in texts.items():
        words = (text or "").encode().lower().split()
        sets[key] = {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: (len(sets[k]), find(k), find(k) == k) for k in keys}


def copies(count=260):
    """A group of near copies around the threshold, a chain, exact copies and unrelated texts."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base = [word() for _ in range(80)]
    out = []
    for _ in range(count):
        words = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3, 4])):
            words[rng.randrange(len(words))] = word()
        out.append(" ".join(words))
    chain = [word() for _ in range(100)]
    for k in range(30):
        chain[3 * k] = word()
        out.append(" ".join(chain))
    out += [out[5]] * 20 + [" ".join(word() for _ in range(rng.randint(1, 60))) for _ in range(60)]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("size", [4, 5])
def test_near_copies_equal_all_pairs(spark, size):
    texts = dict(enumerate(copies()))
    df = spark.createDataFrame([(k, t, "en", "clash") for k, t in texts.items()], "doc_id long, text string, cls string, component string").repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_copies.near_copies(df, size, 80).collect()}
    assert got == links_by_force(texts, size, 80)
    kept = near_copies.one_of_each(df, size, 80)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {k for k, v in got.items() if v[2]}


def test_near_copies_of_odd_rows(odd, none):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_copies.near_copies(odd, 4, 80).collect()}
    assert got == links_by_force(texts_of(odd), 4, 80)
    assert near_copies.near_copies(none, 4, 80).count() == 0


def test_min_max_estimates_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
    b = np.concatenate([a[:800], rng.integers(0, 1 << 63, 200, dtype=np.uint64)])
    s = near_copies.min_max(np.concatenate([a, b]), np.array([0, 1000, 2000]))
    assert abs((s[0] == s[1]).mean() - 800 / 1200) < 0.15


def test_block_links_equal_set_arithmetic():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50)).astype(np.uint64)) for _ in range(40)]
    bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    block = (np.concatenate(sets), bounds)
    x, y = near_copies.block_links(block, block, 50)
    want = {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if 100 * len(np.intersect1d(a, b)) >= 50 * len(np.union1d(a, b))}
    assert set(zip(x.tolist(), y.tolist(), strict=True)) == want


# scores


def scores_by_force(texts):
    held = {k: zlib.crc32(str(k).encode()) % 7 == 2 for k in texts}
    tokens = {k: [b"<s>", *(t or "").encode().lower().split(), b"</s>"] for k, t in texts.items()}
    ones, pairs = Counter(), Counter()
    for k, t in tokens.items():
        if not held[k]:
            ones.update(t[1:])
            pairs.update(zip(t, t[1:], strict=False))
    total, kinds, d = sum(ones.values()), len(ones), backoff_automaton.DISCOUNT
    after = Counter(h for h, _ in pairs)
    context = Counter(ones)
    context[b"<s>"] = sum(not h for h in held.values())
    out = {}
    for k, t in tokens.items():
        base = score = 0.0
        for h, w in zip(t, t[1:], strict=False):
            base += math.log10((ones[w] + 1) / (total + kinds + 1))
            p = (ones[w] - d) / total if ones[w] else d * kinds / total
            if context[h]:
                p = max(pairs[h, w] - d, 0) / context[h] + d * after[h] / context[h] * p
            score += math.log10(p)
        out[k] = (held[k], len(t) - 1, sum(ones[w] > 0 for w in t[1:]), total, base, score)
    return out


@pytest.mark.parametrize("table", ["odd", "documents"])
def test_backoff_scores(request, table, monkeypatch):
    df = request.getfixturevalue(table)
    monkeypatch.setattr(backoff_automaton, "BUCKET", 1 << 14)  # many buckets, so that requests are really cut
    got = by_id(backoff_automaton.score_texts(df))
    want = scores_by_force(texts_of(df))
    assert got.keys() == want.keys()
    for k, w in want.items():
        g = got[k]
        assert (g["held_out"], g["n_tokens"], g["n_known"], g["train_tokens"]) == w[:4]
        assert g["base_score"] == pytest.approx(w[4], rel=1e-9) and g["score"] == pytest.approx(w[5], rel=1e-9)


def test_backoff_without_rows(none):
    assert backoff_automaton.score_texts(none).count() == 0


def test_backoff_state_sums_to_one(spark):
    rows = [(k, t) for k, t in enumerate(["a b a", "a c", "b b a c"]) if zlib.crc32(str(k).encode()) % 7 != 2]
    ask = [(100 + k, f"a {w}") for k, w in enumerate(["a", "b", "c", "unseen", ""])]
    train = spark.createDataFrame(rows + ask, "doc_id long, text string")
    got = by_id(backoff_automaton.score_texts(train, held_out=lambda k: k >= 100))
    first = {k: got[100 + k]["score"] for k in range(5)}
    # P(x|a) for each next word; the end follows "a" directly in the last text
    prefix = got[104]["score"]
    ends = scores_by_force({k: t for k, t in rows})
    assert ends and prefix < 0 and all(v <= 0 for v in first.values())


def test_toxicity_learns_words_and_their_parts(spark):
    rng = random.Random(4)
    plain = ["house", "river", "stone", "walk", "green", "paper", "light", "under", "table", "horse"]
    coined = lambda: "gromf" + "".join(rng.choice("aeiou") for _ in range(3))
    rows = []
    for k in range(1200):
        words = rng.choices(plain, k=rng.randint(8, 60))
        toxic = k % 5 == 0
        for _ in range(max(1, len(words) // 25) if toxic else 0):
            words[rng.randrange(len(words))] = coined()
        rows.append((k, " ".join(words), int(toxic)))
    rows += [(2000, None, 0), (2001, "", 0), (2002, "  ", 0)]
    docs = spark.createDataFrame([(k, t, "x") for k, t, _ in rows], "doc_id long, text string, evidence string")
    labels = spark.createDataFrame([(k, y, "clash") for k, _, y in rows] + [(None, 1, ""), (5, None, ""), (9999, 1, "")], "doc_id long, toxic int, text string")
    got = by_id(toxicity.score_toxicity(docs, labels, 0.3, most=400))
    assert len(got) == len(rows)
    held = [(got[k], y) for k, t, y in rows if zlib.crc32(str(k).encode()) % 4 == 2]
    assert all(g["held_out"] for g, _ in held) and sum(g["held_out"] for g in got.values()) == len(held)
    assert all(0 <= g["score"] <= 1 for g in got.values())
    hits = sum(g["predicted"] == y for g, y in held)
    assert hits >= 0.97 * len(held)
    assert got[2000]["score"] == got[2001]["score"] == got[2002]["score"] < 0.3
    kept = toxicity.ordinary_documents(docs, labels, 0.3, most=400)
    assert kept.columns == docs.columns and 900 <= kept.count() <= 985


def test_toxicity_without_labels(odd, none, spark):
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["score"] < 0.01 for r in toxicity.score_toxicity(odd, empty).collect()} == {True}
    assert toxicity.score_toxicity(none, empty).count() == 0


# decontamination


def test_myers_equals_the_table():
    rng = random.Random(2)
    for _ in range(200):
        p, t = ("".join(rng.choice("ab c") for _ in range(n)) for n in (rng.randint(1, 80), rng.randint(0, 120)))
        row = list(range(len(p) + 1))
        best = row[-1]
        for c in t:
            new = [0]
            for i, x in enumerate(p):
                new.append(min(new[i] + 1, row[i + 1] + 1, row[i] + (x != c)))
            row, best = new, min(best, new[-1])
        assert decontamination.Myers(p).best(t)[0] == best


def test_contaminated_documents(spark, odd, none):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    items = [" ".join(word() for _ in range(rng.randint(8, 40))) for _ in range(30)]
    benchmark = spark.createDataFrame([(k, t, "x") for k, t in enumerate(items)] + [(50, None, "x"), (51, "", "x"), (52, "short", "x"), (None, items[0], "x")], "item_id long, text string, doc_id string")
    noise = lambda: " ".join(word() for _ in range(rng.randint(0, 80)))
    rows, want = [(None, None), (0, ""), (1, noise())], {}
    for k in range(120):
        n = rng.randrange(30)
        text = list(items[n])
        budget = decontamination.edits_allowed(len(decontamination.normal(items[n].encode())))
        edits = rng.randint(0, budget)
        for _ in range(edits):
            at = rng.randrange(len(text))
            text[at : at + 1] = rng.choice([["q"], [], [text[at], "q"]])
        rows.append((10 + k, f"{noise()} {''.join(text).upper() if k % 2 else ''.join(text)}. {noise()}"))
        want[10 + k] = (n, edits)
    docs = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, item_id string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontamination.contaminated(docs, benchmark).collect()}
    assert {(k, n) for k, (n, _) in want.items()} == set(got)
    assert all(got[k, n]["edits"] <= edits for k, (n, edits) in want.items())
    assert {r["doc_id"] for r in decontamination.clean_documents(docs, benchmark).collect()} == {None, 0, 1}
    assert decontamination.contaminated(none, benchmark).count() == 0 == decontamination.contaminated(odd, benchmark.limit(0)).count()
    assert decontamination.clean_documents(odd, benchmark.limit(0)).count() == odd.count()


def test_short_items_stand_at_word_boundaries(spark):
    """Also items without an id, items in several blocks, and two lengths under one id."""
    items = [(1, "Who wrote Hamlet?"), (2, "谁写了红楼梦"), (3, "art"), (4, "ไทย"), (5, "who founded rome then"), (5, "où"), (None, "no id"), (7, "..."), (8, None)]
    texts = ["Q: who WROTE hamlet, then?", "who wrote hamlets", "请问谁写了红楼梦呢", "the cart starts", "fine art.", "ประเทศไทยมี", "x who foundd rome then y", "xwho foundd rome theny", "là où elle", "oùx couù", "it has no id", "nothing here", None]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    want = {(0, 1, 0, 16), (2, 2, 0, 6), (4, 3, 0, 3), (5, 4, 0, 3), (6, 5, 1, 21), (8, 5, 0, 2)}
    for most in (1, decontamination.BLOCK):
        assert {(r["doc_id"], r["item_id"], r["edits"], r["n_chars"]) for r in decontamination.contaminated(docs, benchmark, most=most).collect()} == want
        assert {r["doc_id"] for r in decontamination.clean_documents(docs, benchmark, most=most).collect()} == {1, 3, 7, 9, 11, 12}


# shards


def test_room_tree_is_best_fit():
    rng = random.Random(8)
    tree, rooms = shard_packing.RoomTree(), []
    for k in range(600):
        if rng.random() < 0.6:
            entry = (rng.randint(0, 50), k)
            tree.add(entry)
            rooms.append(entry)
        else:
            least = rng.randint(0, 60)
            want = min((e for e in rooms if e[0] >= least), default=None)
            assert tree.take(least) == want
            if want:
                rooms.remove(want)


def test_bins():
    rng = random.Random(9)
    items = [shard_packing.Item(k, rng.randint(1, 100)) for k in range(300)]
    placed = shard_packing.fewest_bins(items, 100)
    load = Counter()
    for i in items:
        load[placed[i.key]] += i.size
    assert max(load.values()) <= 100 and len(load) <= math.ceil(sum(i.size for i in items) / 100 * 11 / 9) + 1
    level = shard_packing.level_bins(items, 7)
    load = Counter()
    for i in items:
        load[level[i.key]] += i.size
    assert len(load) == 7 and max(load.values()) - min(load.values()) <= 10
    assert shard_packing.level_bins([], 7) == {}


def test_shards_of_odd_rows(odd, none):
    rows = shard_packing.shard_rows(odd, 5).collect()
    texts = texts_of(odd)
    homes = {}
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 16, zlib.crc32(raw), "bytes", None)
        assert homes.setdefault(raw, r["shard"]) == r["shard"] and 0 <= r["shard"] < 5
    for shard in {r["shard"] for r in rows}:
        slots = sorted(r["slot"] for r in rows if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    assert shard_packing.shard_rows(none, 5).count() == 0


def test_shards_are_level(documents):
    load = Counter()
    for r in shard_packing.shard_rows(documents.unionByName(documents.withColumn("text", F.concat("text", F.col("doc_id").cast("string")))), 6).collect():
        load[r["shard"]] += r["size"]
    assert len(load) == 6 and max(load.values()) - min(load.values()) <= 0.01 * max(load.values())


# search


def test_top_k_with_odd_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(k, rng.normal(0, 1, 24).astype(np.float32).tolist(), "x") for k in range(700)]
    rows += [(700 + k, rows[k][1], "x") for k in range(50)]
    rows += [(800, None, "x"), (801, [], "x"), (802, [None] * 24, "x"), (803, [float("nan")] * 24, "x"), (804, [1.0, 2.0], "x"), (900, [3.0, 1.0], "x"), (805, [1e20] * 24, "x"), (None, rows[0][1], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string").repartition(4)
    got = {}
    for r in segment_search.top_k(df, df.where("vec_id % 100 = 0"), 10, block_size=3).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    whole = {k: [math.floor(1024 * float(np.float32(v))) for v in x] for k, x, _ in rows if k is not None and x and all(v is not None and math.isfinite(v) for v in x)}
    clamp = lambda s: min(max(s, segment_search.BOTTOM), segment_search.TOP)
    for q in (k for k in whole if k % 100 == 0):
        ranked = sorted(((-sum(a * b for a, b in zip(whole[q], x, strict=True)), k) for k, x in whole.items() if k != q and len(x) == len(whole[q])))[:10]
        assert got[q] == {n + 1: (k, clamp(-s)) for n, (s, k) in enumerate(ranked)}
    assert segment_search.top_k(df.limit(0), df.limit(0)).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(4)
    q, x = rng.normal(0, 50, (40, 30)), rng.normal(3, 20, (60, 30))
    for parts in segment_search.LEVELS:
        assert (segment_search.statistics(q, parts) @ segment_search.statistics(x, parts).T >= q @ x.T - 1e-6).all()


# urls


def test_rules_and_hosts(spark):
    urls = [None, "", "no scheme", "http://EXAMPLE.org/es/x?y", "http://a.example.org/en/1#z", "https://org/", "https://x.com/fr", "https://x.com/de/9", "https://x.com", "a://b://c/d", "http://x.net/é?q", "http://u.com/en", "http://y.com/en", "http://w.com/fr/", "http://www.w.com/fr/a", "http://z.com/france"]
    html = {11: "<a href='http://X.com/de/1'>bad</a><a href=\"//x.com/de/2\">bad</a>", 12: "<a href='http://x.org/'>good</a>", 7: "<a href='http://u.com/q'>", 5: "<a class=k href=http://y.com/en>t</a>"}
    pages = spark.createDataFrame([(k, u, html.get(k), "x") for k, u in enumerate(urls)], "page_id long, url string, html string, host string")
    got = by_id(host_trust.judge_urls(pages), "page_id")
    assert [(got[k]["host"], got[k]["path"], got[k]["rule"]) for k in range(len(urls))] == [
        ("", "", None), ("", "", None), ("", "", None), ("example.org", "/es/x", "example.org/es/"), ("a.example.org", "/en/1", "example.org/en/1"), ("org", "/", "org/"), ("x.com", "/fr", None),
        ("x.com", "/de/9", "com/de/"), ("x.com", "", None), ("b:", "//c/d", None), ("x.net", "/é", None), ("u.com", "/en", None), ("y.com", "/en", None), ("w.com", "/fr/", "com/fr/"), ("www.w.com", "/fr/a", "com/fr/"), ("z.com", "/france", None),
    ]
    verdicts = {k: got[k]["verdict"] for k in got}
    assert verdicts[0] == "allow" and verdicts[3] == "block" and verdicts[5] == "allow" and verdicts[7] == "block"
    assert verdicts[13] == verdicts[14] == "allow" and verdicts[6] == "block"  # the host's own pages under /de/ are blocked
    assert verdicts[11] == "block" and verdicts[12] == "allow" and got[11]["distrust"] > 0 and got[12]["trust"] > 0
    assert host_trust.judge_urls(pages.limit(0)).count() == 0


def test_distrust_reaches_far_hosts_with_small_shares(spark):
    """Twenty levels of 30 hosts, each of which links to one host of the level below; shares fall to 30 ** -20."""
    rows = [("http://b.com/de/1", None)] + [(f"http://h{k}-{i}.net/", f"<a href='http://{f'h{k - 1}-0.net' if k else 'b.com'}/'>") for k in range(20) for i in range(30)]
    got = by_id(host_trust.judge_urls(spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "page_id long, url string, html string")), "page_id")
    assert {r["verdict"] for r in got.values()} == {"block"} and min(r["distrust"] for r in got.values()) < 1e-28


def test_trust_solves_its_equations(spark):
    """Circles, a host without links, and a circle that is ten hops behind a seed, against a dense solution."""
    pairs = [(0, 1, 3), (1, 2, 1), (2, 0, 2), (1, 3, 5), *[(k, k + 1, 1) for k in range(4, 14)], (14, 12, 1), (0, 4, 1)]
    seeds = {0: 0.999999, 2: 0.000001}
    moves = np.zeros((15, 15))
    for src, dst, links in pairs:
        moves[dst, src] = links / sum(n for a, _, n in pairs if a == src)
    start = np.array([seeds.get(k, 0.0) for k in range(15)])
    moves[:, moves.sum(axis=0) == 0] = start[:, None]
    want = np.linalg.solve(np.eye(15) - host_trust.DAMPING * moves, (1 - host_trust.DAMPING) * start)
    links = spark.createDataFrame([("good", str(a), str(b), n) for a, b, n in pairs], "kind string, src string, dst string, links long")
    got = by_id(host_trust.spread(links, spark.createDataFrame([("good", str(k), x) for k, x in seeds.items()], "kind string, host string, mass double")), "host")
    assert np.allclose([got[str(k)]["mass"] for k in range(15)], want, rtol=1e-10, atol=0)


# pages


@pytest.fixture(scope="module")
def labeller(spark, folder):
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    return page_text.train(page_text.training_pages(page_text.sample_pages(pages, 240)))


def test_main_text_of_given_pages(spark, folder, labeller):
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    got = by_id(page_text.main_texts(pages, model=labeller), "page_id")
    for r in pages.collect():
        want = "\n".join(b.text for b in page_text.read_blocks(r["html"]) if page_text.markup_label(b.path) == 1)
        assert got[r["page_id"]]["text"] == want and got[r["page_id"]]["n_chars"] == len(want)


def test_blocks_of_loose_markup():
    page = "<p>a &amp; b<br>c<p>d<b>e</b>\n\n f<ul><li>g<li>h</ul><script>if (a<b) x='</p>'</script><!-- <p>no</p> --><div style='display:none'>no</div><table><tr><td>i<td>j</table>k &lt;x&gt;"
    assert [b.text for b in page_text.read_blocks(page)] == ["a & b c", "de f", "g", "h", "i", "j", "k <x>"]
    assert page_text.read_blocks("") == [] == page_text.read_blocks("<p> <br>&nbsp;</p>")


def test_odd_pages(spark, labeller):
    body = "".join(f"<p>Some plain sentence number {k}, and then a few more words.</p>" for k in range(3000))
    rows = [(1, None, None), (2, "u", ""), (3, "u", "<nav><a href=x>Menu</a></nav>"), (4, "u", f"<html><body><nav>x</nav><article>{body}</article><footer>f</footer>"), (4, "u", "<article><h1>T</h1><p>One thing, said well.</p></article><div class=comments><p>Nice!</p></div>")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    got = sorted((r["page_id"], r["text"].count("\n"), r["n_chars"]) for r in page_text.main_texts(pages, model=labeller).collect())
    assert got[:3] == [(1, 0, 0), (2, 0, 0), (3, 0, 0)] and got[4][1] == 2999 and got[3][2] == len("T\nOne thing, said well.")
    assert page_text.main_texts(pages.limit(0)).count() == 0


def test_gradients_are_slopes():
    blocks = [page_text.Block("some words here", ["t.p", "c.x"], 3), page_text.Block("more", ["t.li"]), page_text.Block("and so on.", ["t.p"])]
    model, f = page_text.Labeller(3), page_text.inputs_of([blocks[:2], blocks])
    y, weight, lengths = np.array([1.0, 0, 1, 0, 1]), np.ones(5), np.array([2, 3])

    def loss():
        z, _ = model.forward(model.vectors(f), lengths)
        return float((np.logaddexp(0, z) - y * z).sum() / 5)

    g = model.gradients(f, lengths, y, weight)
    for name, at in (("fw_x", (1, 3)), ("bw_h", (2, 5)), ("bw_b", (40,)), ("out", (4,)), ("path", (f.path_ids[0], 2)), ("word", (f.word_ids[0], 1))):
        keep = model.w[name][at]
        model.w[name][at] = keep + 1e-5
        up = loss()
        model.w[name][at] = keep - 1e-5
        down = loss()
        model.w[name][at] = keep
        assert g[name][at] == pytest.approx((up - down) / 2e-5, abs=1e-6)
