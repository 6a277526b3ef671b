"""Operators of the subpackage llm against brute force, round trips and edge cases."""

import base64
import random
import re
from collections import defaultdict

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessaria.llm import components, encode, history, leaks, mainbody, neardup, queries, subjects
from tessaria.llm.words import Words, shingles

SF = "/root/testdata/sf0.001"
rng = random.Random(7)


def words(s):
    return re.findall("[a-z0-9]+", (s or "").lower())


# ---- p1


def brute_components(pairs):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        if x != y:
            up[max(x, y)] = min(x, y)
    return {x: find(x) for x in up}


@pytest.mark.parametrize("block", [3, 50, 100_000])
def test_components(spark, block):
    n = [f"n{i:03d}" for i in range(120)]
    pairs = [(rng.choice(n[:60]), rng.choice(n[:60])) for _ in range(45)] + [("n070", x) for x in n[71:110]] + list(zip(n[110:], n[111:], strict=False))
    rng.shuffle(pairs)
    df = spark.createDataFrame(pairs + pairs[:9], "u string, v string").repartition(4)
    got = {r.node: r.component for r in components.connected_components(df, block).collect()}
    assert got == brute_components([p for p in pairs if p[0] != p[1]])


def test_consolidate_edges(spark):
    rows = [([" A", "b "],), (["B", None, "", "c"],), (None,), ([],), (["x"],), (["y", "Y "],), (["c", "a"],)]
    df = spark.createDataFrame(rows, "member_hashes array<string>").withColumn("node", F.lit(1)).withColumn("component", F.lit("z"))
    assert sorted(map(tuple, components.consolidate(df, "member_hashes").collect())) == [("a", "a"), ("b", "a"), ("c", "a")]
    assert components.consolidate(df.limit(0), "member_hashes").count() == 0


# ---- p2


PAGE = """Site Wire
* News
* Events

Alpha breach in Beta
By the Site desk, 3 May 2024
On Monday, the operators of Alpha copied the files of Beta and left.\r
Advertisement
Background
- Rotate credentials that may have been exposed.
$ alpha --target 192.0.2.1
192.0.2.7
alpha[.]example
Later the same group asked for coins, and nothing was paid at all.
Related stories
Gamma breach in Delta
Comments (3)
Honestly Beta should have told customers in May, this is not right at all.
Copyright Site Wire 2024"""


def test_main_body():
    assert mainbody.body_lines(PAGE, "Alpha breach in Beta - Site Wire") == [5, 7, 9, 10, 11, 12, 13, 14]
    assert mainbody.body_lines(PAGE, None) == [5, 7, 9, 10, 11, 12, 13, 14]
    assert mainbody.body_lines(PAGE.replace("Alpha breach in Beta", "<h1>Alpha breach in Beta</h1>"), "Alpha breach in Beta")[0] == 5
    for nothing in (None, "", "  \n ", "* News\n* Events\nCopyright X 2024", "Comments (2)\nHonestly they should have told us about it in May, really."):
        assert mainbody.body_lines(nothing, "T t") == []
    assert len(mainbody.body_lines("A headline of words\n" + "This is a sentence of the body, long enough to count.\n" * 20_000, None)) == 20_001


def test_main_body_frame(spark):
    df = spark.createDataFrame([("t", 1, None, PAGE, 5), ("t", 1, None, PAGE, 5), ("t", 2, "x", None, 5)], "tbl string, row_id long, title string, text string, line_no int")
    assert mainbody.main_body(df).count() == 16
    assert mainbody.main_body(df.limit(0)).count() == 0


# ---- p6 and p4


def edited(base, n):
    w = base.split()
    for _ in range(n):
        i = rng.randrange(len(w))
        w[i : i + 1] = rng.choice(([], [f"zz{rng.randrange(999)}"], [w[i], "also"]))
    return " ".join(w)


def corpus():
    vocabulary = [f"w{i}" for i in range(300)]
    boiler = " ".join(rng.choice(vocabulary) for _ in range(25))
    out = []
    for i in range(60):
        base = " ".join(rng.choice(vocabulary) for _ in range(rng.choice((4, 9, 25, 60, 120))))
        if i % 3 == 0:
            base += " " + boiler
        out += [edited(base, rng.choice((0, 0, 1, 2, 4))) for _ in range(rng.choice((1, 2, 4)))]
    return [*out, None, "", "one two", "One, TWO three!", "one two three", "x " * 5000, "x " * 4000 + "y z", boiler, boiler + " end"]


def similar(texts, k, t):
    sets = [set(zip(*[words(x)[i:] for i in range(k)], strict=False)) for x in texts]
    return {(i, j) for j in range(len(sets)) for i in range(j) if sets[i] and sets[j] and len(sets[i] & sets[j]) >= t * len(sets[i] | sets[j]) - 1e-9}


@pytest.mark.parametrize("most", [4, 1000])
@pytest.mark.parametrize(("k", "t"), [(3, 0.7), (5, 0.8)])
def test_near_duplicates(spark, monkeypatch, most, k, t):
    monkeypatch.setattr(neardup, "LIST", most)
    texts = corpus()
    df = spark.createDataFrame(list(enumerate(texts)), "item_id long, title string").withColumn("id", F.lit("clash")).withColumn("n", F.lit(0))
    pairs, members = neardup.near_duplicates(df, "item_id", ["title"], k, t)
    got = {tuple(r) for r in neardup.all_pairs(pairs, members, "x", "y").collect()}
    assert got == similar(texts, k, t)


def found_near(spark, texts):
    pairs, members = neardup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "item_id long, title string"), "item_id", ["title"], 3, 0.7)
    return {tuple(r) for r in neardup.all_pairs(pairs, members, "x", "y").collect()}


def test_near_duplicates_hot_list(spark, monkeypatch):
    """Pairs whose only common retained value has a list over LIST: a text, and longer ones that hold it whole."""
    monkeypatch.setattr(neardup, "LIST", 20)
    monkeypatch.setattr(neardup, "RARE", 4)
    base = " ".join(f"v{i}" for i in range(16))
    texts = [base, *(f"{base} " + " ".join(f"own{i}x{j}" for j in range(6)) for i in range(30))]
    want = similar(texts, 3, 0.7)
    assert len(want) == 30 and found_near(spark, texts) == want


def variants(size, count, most):
    base = [f"v{i}" for i in range(size)]
    out = []
    for _ in range(count):
        w = list(base)
        for _ in range(rng.randint(2, most)):
            w[rng.randrange(size)] = f"zz{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_near_duplicates_large_group(spark):
    """Groups whose shared values are frequent while each text's own ones are rare."""
    texts = variants(150, 300, 4) + [f"u {x}" for x in variants(60, 200, 3)]
    want = similar(texts, 3, 0.7)
    assert len(want) > 10_000 and found_near(spark, texts) == want


def test_near_duplicates_empty(spark):
    df = spark.createDataFrame([], "item_id long, title string")
    pairs, members = neardup.near_duplicates(df, "item_id", ["title"])
    assert neardup.all_pairs(pairs, members, "x", "y").count() == 0


def greedy(texts, keys, t):
    near = defaultdict(set)
    for i, j in similar(texts, 3, t):
        near[j].add(i)
    accepted, found = set(), {}
    for i in range(len(texts)):
        hits = [j for j in accepted if j in near[i] or (keys[i] and keys[i] == keys[j])]
        if hits:
            found[i] = min(hits)
        else:
            accepted.add(i)
    return found


@pytest.mark.parametrize("most", [0, 1_000_000])
def test_admit(spark, monkeypatch, most):
    """Each batch comes in a session of its own, which opens the store anew and knows no later text."""
    monkeypatch.setattr(history, "RESOLVE_ROWS", most)
    monkeypatch.setattr(history, "CAPACITY", 200)  # layers are closed and opened
    texts = corpus()
    rng.shuffle(texts)
    keys = [rng.choice([None, f"k{rng.randrange(150)}"]) for _ in texts]
    df = spark.createDataFrame([(i, i * 3 // len(texts), k, x or "") for i, (x, k) in enumerate(zip(texts, keys, strict=True))], "id long, batch_no int, key string, text string")
    path, got = history.Store(spark).path, {}
    for b in range(4):  # the last batch is empty
        got |= {r.id: r.kept for r in history.admit(history.Store(spark, path), df.filter(F.col("batch_no") == b).drop("batch_no"), b, 3, 0.7).collect()}
    assert got == greedy(texts, keys, 0.7)
    again = history.admit(history.Store(spark, path), df.filter("batch_no = 1").drop("batch_no"), 1, 3, 0.7)
    assert {r.id: r.kept for r in again.collect()} == {i: k for i, k in got.items() if i * 3 // len(texts) == 1}
    with pytest.raises(ValueError, match="another size"):
        history.admit(history.Store(spark, path), df.drop("batch_no"), 9, 5, 0.8)


def test_admit_failure_leaves_nothing(spark, monkeypatch):
    store = history.Store(spark)
    rows = spark.createDataFrame([(1, "a", "one two three four"), (2, "b", "one two three four")], "id long, key string, text string")
    monkeypatch.setattr(history.Store, "commit", lambda self, entry: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        history.admit(store, rows, 0, 3, 0.7)
    monkeypatch.undo()
    store = history.Store(spark, store.path)
    assert not store.commits and [tuple(r) for r in history.admit(store, rows, 0, 3, 0.7).collect()] == [(2, 1)]


def moved(spark):
    """Rows written to shuffles so far."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}


def test_admit_moves_no_history(spark, monkeypatch):
    """What a batch moves is the batch: the store's 9,000 fingerprints stay where they lie, also those of a batch too large to be sent to them."""
    monkeypatch.setattr(history, "SENT_BYTES", 0, raising=False)
    texts = [" ".join(f"t{i}w{j}" for j in range(60)) for i in range(500)]
    first = spark.createDataFrame([(i, None, x) for i, x in enumerate(texts)], "id long, key string, text string")
    second = spark.createDataFrame([(500 + i, None, x + " end") for i, x in enumerate(texts[::100])], "id long, key string, text string")
    path = history.Store(spark).path
    assert history.admit(history.Store(spark, path), first, 0, 3, 0.7).isEmpty()
    before = moved(spark)
    got = {r.id: r.kept for r in history.admit(history.Store(spark, path), second, 1, 3, 0.7).collect()}
    assert got == {500 + i: 100 * i for i in range(5)}
    assert sum(n for stage, n in moved(spark).items() if stage not in before) < 2000


def test_admit_value_of_many_rows(spark, monkeypatch):
    """Fingerprints that more than LIST rows of a batch have in common, with each other and with the store."""
    monkeypatch.setattr(neardup, "LIST", 10)
    texts = variants(40, 90, 2) + variants(40, 5, 2)
    keys = [f"k{i % 70}" if i % 3 else None for i in range(len(texts))]
    df = spark.createDataFrame([(i, k, x) for i, (x, k) in enumerate(zip(texts, keys, strict=True))], "id long, key string, text string")
    path, got = history.Store(spark).path, {}
    for b, some in enumerate(("id < 30", "id >= 30")):
        got |= {r.id: r.kept for r in history.admit(history.Store(spark, path), df.filter(some), b, 3, 0.7).collect()}
    assert got == greedy(texts, keys, 0.7)


def test_admit_order_of_rarity_from_first_batch(spark):
    """Runs that become frequent only later: every near-duplicate of an earlier batch is found."""
    vocabulary = [f"w{i}" for i in range(4000)]
    late = " ".join(f"late{i}" for i in range(30))
    first = [" ".join(rng.choice(vocabulary) for _ in range(60)) + (f" {late}" if i < 2 else "") for i in range(60)]
    second = [edited(x, 2) for x in first] + [" ".join(rng.choice(vocabulary) for _ in range(40)) + f" {late}" for _ in range(80)]
    texts = first + second
    df = spark.createDataFrame([(i, None, x) for i, x in enumerate(texts)], "id long, key string, text string")
    path, got = history.Store(spark).path, {}
    for b, some in enumerate(("id < 60", "id >= 60")):
        got |= {r.id: r.kept for r in history.admit(history.Store(spark, path), df.filter(some), b, 3, 0.7).collect()}
    assert len(got) >= 50 and got == greedy(texts, [None] * len(texts), 0.7)


def test_replay_early_batches(spark):
    rows = [(1, -3, "a"), (2, -1, "a"), (3, None, "b"), (4, 5, "b")]
    got = queries._replay(spark.createDataFrame(rows, "id long, batch_no int, key string"))
    assert sorted((r.id, r.kept) for r in got.collect()) == [(2, 1), (4, 3)]


def test_replay_makes_each_row_once(spark):
    """However many batches there are, the input is read once."""
    made = spark.sparkContext.accumulator(0)
    key = F.udf(lambda i: made.add(1) or f"k{i % 50}").asNondeterministic()
    got = queries._replay(spark.range(60).select("id", F.expr("cast(id div 10 as int) batch_no"), key("id").alias("key")))
    assert sorted((r.id, r.kept) for r in got.collect()) == [(50 + i, i) for i in range(10)]
    assert made.value == 60


def test_admit_keys_only(spark):
    store = history.Store(spark)
    first = history.admit(store, spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, "b")], "id long, key string"), 0).collect()
    second = history.admit(store, spark.createDataFrame([(5, "b"), (6, None), (7, "c")], "id long, key string"), 1).collect()
    assert [tuple(r) for r in first] == [(2, 1)] and [tuple(r) for r in second] == [(5, 4)]


# ---- p7


@pytest.fixture(scope="module")
def vocab():
    return encode.vocabulary(f"{encode.VOCABULARIES}/byte_bpe_50k.tiktoken")


def test_encoding_equals_reference_library(vocab):
    tiktoken = pytest.importorskip("tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(f"{encode.VOCABULARIES}/byte_bpe_50k.tiktoken", "rb"))}  # noqa: SIM115
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    parts = ["'", "s", "re", "'s", "'ll", " ", "  ", "\n", "1", "²", "é", "日", "!", "a", "D", "\t", " ", "😀", "​", "Ⅷ", "\r\n", "́", "<|endoftext|>"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(25))) for _ in range(3000)] + ["", "a" * 3000, "ab" * 900, " " * 999 + "x"]
    ids, many, places = encode.encode_texts(texts, vocab)
    at = 0
    for t, n in zip(texts, many, strict=True):
        assert ids[at : at + n].tolist() == enc.encode_ordinary(t)
        assert encode.decode(ids[at : at + n].tolist(), vocab) == t
        assert all(0 <= p < max(1, len(t)) for p in places[at : at + n])
        at += n


def test_encode_corpus(spark):
    df = spark.createDataFrame([(1, "Hello world"), (2, ""), (3, None), (1, "Hello world")], "doc_id long, text string").withColumn("ids", F.lit(0))
    got = [(r.doc_id, list(r.ids)) for r in encode.encode_corpus(df).collect()]
    assert sorted(got) == [(1, [15496, 995]), (1, [15496, 995]), (2, []), (3, [])]
    assert encode.encode_corpus(df.limit(0)).count() == 0
    assert list(encode.encode_corpus(df, offsets=True).filter("doc_id = 1").first().starts) == [0, 5]


def test_states_scan_equals_sequential():
    for n in (1, 63, 64, 65, 1000, 5001):
        s = pd.Series([rng.randrange(9) for _ in range(n)]).to_numpy(dtype="uint8")
        state, want = encode.START, []
        for x in s:
            want.append(state)
            state = int(encode.NEXT[x, state])
        assert encode.states_before(s).tolist() == want


# ---- p8


def test_leaks(spark):
    passage = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu"
    items = [(1, passage), (2, "Short one, here"), (3, None), (4, "!!"), (5, "a b"), (5, "a b")]
    docs = [
        (1, "x " * 50 + "BETA, gamma delta; epsilon zeta eta theta iota kappa lambda. y"), (2, "beta gamma delta epsilon zeta eta theta iota kappa and lambda mu nu"),
        (3, "it says short one here twice: short one here"), (4, None), (5, ""), (6, "shorts one here"), (7, "word " * 60_000 + passage), (8, "a b c"), (9, "alpha beta"),
    ]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("eval_id", F.lit(0))
    e = spark.createDataFrame(items, "eval_id long, passage string").withColumn("text", F.lit("x"))
    want = [(1, 1), (3, 2), (7, 1), (8, 5), (8, 5)]
    assert sorted(map(tuple, leaks.find_leaks(d, e).collect())) == want
    assert sorted(map(tuple, leaks.find_leaks(d, e, block_chars=20).collect())) == want  # several blocks of passages
    assert (2, 1) in {tuple(r) for r in leaks.find_leaks(d, e, max_edits=1).collect()}
    assert leaks.find_leaks(d.limit(0), e).count() == 0 and leaks.find_leaks(d, e.limit(0)).count() == 0


def test_leaks_brute_force(spark):
    d, e = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/eval_items.parquet")
    grams = defaultdict(set)
    for r in e.collect():
        w = words(r.passage)
        k = min(10, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            grams[tuple(w[i : i + k])].add(r.eval_id)
    want = set()
    for r in d.collect():
        w = words(r.text)
        for k in {len(g) for g in grams}:
            for i in range(len(w) - k + 1):
                want |= {(r.doc_id, x) for x in grams.get(tuple(w[i : i + k]), ())}
    assert {tuple(r) for r in leaks.find_leaks(d, e).collect()} == want


# ---- p9


def test_subjects_edge_cases(spark):
    texts = {
        "law": ["The jury heard the plaintiff. The injunction and the affidavit were filed.", "A tribunal and a jury met the plaintiff. The affidavit named the tribunal."],
        "sport": ["The goalkeeper and the referee met. A marathon and a penalty decided it.", "The referee saw the penalty. The goalkeeper ran the marathon."],
        "health": ["The clinic called a nurse. A vaccine and a ward were named.", "The ward had a nurse. The clinic kept the vaccine."],
        "energy": ["The turbine and the refinery met. A substation and a reactor were named.", "A reactor fed the substation. The refinery saw the turbine."],
    }
    own = {i: list(texts)[i % 4] for i in range(1, 121)}
    docs = [(i, texts[s][i // 4 % 2], "en") for i, s in own.items()] + [(200, None, None), (201, "", "en"), (202, "!!!", None), (203, "The jury and the tribunal left.", None)]
    labels = [(i, f" {own[i].upper()} ", "a") for i in range(1, 81)] + [(None, "law", "a"), (2, None, "a"), (3, "nonsense", "a")]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumn("subject", F.lit("clash"))
    lab = spark.createDataFrame(labels, "doc_id long, subject string, annotator string").withColumn("text", F.lit("clash"))
    got = {(r.doc_id, r.subject) for r in subjects.subject_areas(d, lab).collect()}
    assert got == set(own.items())
    assert subjects.subject_areas(d, lab.limit(0)).count() == 0
    assert subjects.subject_areas(d.limit(0), lab).count() == 0


# ---- words and registered queries


def test_words():
    w = Words(["Ab-c 12", "", "É a", "K"])
    assert w.counts().tolist() == [3, 0, 1, 1]
    a, b = Words(["x one two three"]), Words(["one two three four"])
    assert set(shingles(a, 3)[0].tolist()) & set(shingles(b, 3)[0].tolist())
    assert len(shingles(Words([]), 3)[0]) == 0


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_runs(spark, name):
    df = queries.QUERIES[name](spark, SF)
    assert df.columns and df.count() > 0
