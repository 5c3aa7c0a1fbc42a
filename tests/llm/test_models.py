"""Quality classifier, secret scan, nearest neighbours and tool links."""

import hashlib
import json
import math
import os
import random
import zlib

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import pytest

from faultsieve.llm import permutation_index as N
from faultsieve.llm import quality_gam as G
from faultsieve.llm import secret_forest as E
from faultsieve.llm import tool_links as T

random.seed(11)
WORDS = ["the", "and", "that", "tion", "river", "stone", "light", "water", "under", "house", "over", "small"]


def prose(n):
    return " ".join(random.choice(WORDS) for _ in range(n)).capitalize() + "."


def junk(n):
    return " ".join(random.choice(WORDS).upper() + "!!" for _ in range(n))


# quality


def test_classifier_learns_from_its_fold_alone(spark, documents):
    rows = [(i, prose(60) if i % 3 else junk(60)) for i in range(240)]
    docs = documents([*rows, (1000, None), (1001, ""), (None, prose(50)), (5, rows[5][1])])
    fold = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    # labels of the held-out fold are wrong on purpose
    labels = [(i, int((i % 3 > 0) != fold(i)), 0) for i in range(240)] + [(None, 1, 0), (3, None, 0), (1000, None, 0)]
    got = G.classify(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(got) == 244
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert r.held_out == (r.doc_id is not None and fold(r.doc_id))
        if r.doc_id is not None and r.doc_id < 240:
            assert r.predicted == int(r.doc_id % 3 > 0)


def test_classifier_without_labels(spark, documents):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = documents([(1, "a"), (2, None)])
    assert [r.score for r in G.classify(docs, none).collect()] == [0.5, 0.5]
    one = spark.createDataFrame([(0, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    assert all(r.predicted == 1 for r in G.classify(docs, one).collect())
    assert G.classify(documents([]), none).count() == 0


def test_stage_drops_rejected_rows_only(spark, documents):
    rows = [(i, prose(60) if i % 2 else junk(60)) for i in range(200)]
    docs = documents(rows)
    kept = G.keep_good(docs, spark.createDataFrame([(i, i % 2, 0) for i in range(200)], "doc_id long, quality int, toxic int"))
    assert kept.schema == docs.schema
    assert {r.doc_id for r in kept.collect()} == {i for i in range(200) if i % 2}


def _plain_features(text):
    """The features by loops over the bytes and words of a text."""
    raw = (text or "").encode()
    words, lines = raw.split(), raw.count(b"\n") + 1
    n, m = max(1, len(raw)), max(1, len(words))
    among = lambda chars: sum(b in chars for b in raw)
    best = run = same = 0
    for a, b in zip(words, words[1:]):
        run = run + 1 if a == b else 0
        same, best = same + (a == b), max(best, run)
    return [
        math.log1p(len(words)), n / m, sum(65 <= b <= 90 for b in raw) / n, among(b"!") / m, among(b"#$%&*<>=~^@") / m, among(b"|") / m, among(b"0123456789") / n, among(b".") / m, among(b",;:") / m, m / lines,
        len(set(words)) / m, same / m, sum(len(w) < 4 for w in words) / m, sum(b < 128 for b in raw) / n, sum(w.islower() for w in words) / m, math.log1p(best),
    ]


def test_scores_as_brute_force(spark, documents):
    """Scores of all rows are what a loop over bins and tables of the learned model adds up for plainly counted features."""
    rng = random.Random(12)
    rows = [(i, (prose if i % 2 else junk)(rng.randrange(1, 80)) + rng.choice(["", "\nand\n", " a a a a", " é|1,2"])) for i in range(150)] + [(900, None), (901, ""), (902, "x" * 100_000)]
    docs, labels = documents(rows), spark.createDataFrame([(i, i % 2, 0) for i in range(150)], "doc_id long, quality int, toxic int")
    model = G.train(docs, labels)
    assert model.pairs and any(t.any() for t in model.tables)
    place = lambda edges, v: sum(v >= e for e in edges)
    got = {r.doc_id: r.score for r in G.classify(docs, labels).collect()}
    for i, text in rows:
        x = _plain_features(text)
        total = model.bias + sum(t[place(e, v)] for e, t, v in zip(model.edges, model.tables, x))
        total += sum(t[place(model.pair_edges[a], x[a]), place(model.pair_edges[b], x[b])] for a, b, t in model.pairs)
        assert abs(got[i] - 1 / (1 + math.exp(-total))) < 1e-9, i


def test_pairs_explain_what_single_features_do_not():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = G.fit(x, y, rounds=20, pair_rounds=40, pairs=2)
    assert {model.pairs[0][0], model.pairs[0][1]} == {0, 1}
    assert ((model.score(x) >= 0.5) == y).mean() > 0.9


# secrets


def hexes(n):
    return "".join(random.choice("0123456789abcdef") for _ in range(n))


def test_secret_scan(spark, documents, monkeypatch):
    monkeypatch.setattr(E, "PLANTED", 1_500)
    rows = []
    for i in range(120):
        rows.append((i, prose(30) + f' token = "{hexes(40)}" ' + prose(5)))
        rows.append((1000 + i, prose(30) + " " + "".join(random.choice(WORDS) for _ in range(5)) + " commit " + hexes(40)))
    extra = [(5000, None), (5001, ""), (5002, "short"), (5003, "x" * 5000), (0, rows[0][1]), (None, f"secret: {hexes(32)}")]
    got = E.scan(documents(rows + extra)).collect()
    found = {(r.doc_id, r.word, r.nth): r for r in got}
    for i in range(1, 120):
        assert [r.is_secret for r in got if r.doc_id == i] == [True]
        assert not any(r.is_secret for r in got if r.doc_id == 1000 + i)
    assert len([r for r in got if r.doc_id == 0]) == 2 and len([r for r in got if r.doc_id == 5003]) == 1
    assert not any(k[0] in (5000, 5001, 5002) for k in found)
    assert [r.is_secret for r in got if r.doc_id is None] == [True]
    assert E.scan(documents([])).count() == 0
    assert not E.scan(documents([(1, "x" * 20)])).collect()[0].is_secret


def test_secrets_in_assignments_without_spaces(spark, documents, monkeypatch):
    monkeypatch.setattr(E, "PLANTED", 3_000)
    r = random.Random(21)
    draw = lambda k: "".join(r.choices("0123456789abcdef", k=k))
    forms = ["TOKEN={}", "aws_secret_access_key={}", "https://host.net/path?page=2&token={}&x=1", '{{"sha": "{other}", "api_key": "{}"}}', '{{"sha":"{other}","api_key":"{}"}}', "COMMIT={other}\nTOKEN={}", 'mail@host6.example.com token = "{}"']
    rows, want = [], {}
    for i in range(280):
        value = draw(40) + ("==" if i % 12 == 0 else "")
        rows.append((i, f"{prose(20)} {forms[i % 7].format(value, other=draw(40))}"))
        want[i] = hashlib.sha256(value.encode()).hexdigest()
    rows += [(1000 + i, f"{prose(20)} commit={draw(40)} etag:{draw(32)}") for i in range(120)]
    got = E.scan(documents(rows)).collect()
    found = [[x.secret_sha256 for x in got if x.doc_id == i and x.is_secret] == [want[i]] for i in want]
    assert sum(found) >= 0.95 * len(found), [rows[i] for i in want if not found[i]][:5]
    assert sum(x.is_secret for x in got if x.doc_id >= 1000) <= 12


def test_short_values_with_punctuation_are_candidates(documents):
    texts = {1: 'the password = "hunter2!Xy9" was', 2: "pwd: Tr0ub4dor&3", 3: "no password: here or there", 4: "token=abc123", 5: "login(secret='p@ss:w0rd')", 6: "one two three = fourfive", 7: "password", 8: "token ="}
    got = {(r.doc_id, r.candidate) for r in E.candidates(documents(texts.items())).collect()}
    assert got >= {(1, "hunter2!Xy9"), (2, "Tr0ub4dor&3"), (4, "abc123"), (5, "p@ss:w0rd")}
    assert not {d for d, _ in got} & {3, 6, 7, 8}


def test_forest_on_held_out_findings(spark, documents):
    """Planted secrets and look-alikes of documents that the forest has not seen, against the labels and against the rule alone."""
    r = random.Random(4)
    words = ["".join(r.choices("abcdefghijklmnoprstuvwy", k=r.randint(3, 9))) for _ in range(300)]
    docs = documents([(i, " ".join(r.choices(words, k=r.randint(1, 60))), r.choice(["src0", "src1"])) for i in range(3000)])
    seen, held = docs.where("doc_id % 3 > 0"), docs.where("doc_id % 3 = 0")
    planted, truth = E.plant(held, salt=77)
    rows = E.scan(planted, findings=E.findings(*E.plant(seen, salt=1), E.words(seen)), features=True).join(truth, ["doc_id", "candidate"]).collect()
    n_ones = truth.where("label = 1").count()
    ones = [x for x in rows if x.label == 1]
    assert len(ones) > 0.98 * n_ones  # planted secrets are candidates, whole and alone; look-alikes need not be
    rule = lambda x: x.credential == 1 and x.assigned == 1 and x.harmless == 0 and 0.1 < x.digits < 1

    def rates(says):
        hits, said = sum(says(x) for x in ones), sum(says(x) for x in rows)
        return hits / said, hits / n_ones

    (precision, recall_), (rule_precision, rule_recall) = rates(lambda x: x.is_secret), rates(rule)
    print("held out", precision, recall_, "rule", rule_precision, rule_recall)
    assert precision >= 0.9 and recall_ >= 0.9, (precision, recall_, rule_precision, rule_recall)
    assert precision > rule_precision and recall_ > rule_recall


def test_features_of_candidates(spark, documents):
    found = E.candidates(documents([(1, 'my api key="AAAA1111bbbb2222cccc;ZZZZ1111bbbb2222cccc" next'), (2, "riverstone/lightwaterxq 0123456789abcdef")]))
    counts = spark.createDataFrame([("river", 9), ("stone", 9), ("light", 9), ("water", 9), ("bbbb", 9), ("rare", 1)], "word string, n long")
    rows = {(r.doc_id, r.nth, r.word): r for r in E.featurize(found, counts).collect()}
    a, b = rows[1, 0, 2], rows[1, 1, 2]
    assert a.length == 20 and a.credential == 1 and a.assigned == 1 and a.quoted == 1 and a.digits == 0.4 and b.length == 20
    assert abs(a.coverage - 4 / 20) < 1e-9 and abs(rows[2, 0, 0].coverage - 20 / 23) < 1e-9 and rows[2, 0, 1].coverage == 0


# nearest neighbours


def test_neighbours_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    vectors = [rng.normal(size=16) * rng.uniform(0.2, 3) for _ in range(400)]
    for i in range(100, 160):
        vectors[i] = vectors[100]  # a group of copies larger than the answer
    rows = [(i, [float(x) for x in v], 0) for i, v in enumerate(vectors)]
    odd = [(1000, None, 0), (1020, [0.0] * 16, 0), (1040, [float("nan")] + [1.0] * 15, 0), (1060, [None] + [1.0] * 15, 0), (1080, [1.0] * 3, 0), (1100, [float("inf")] * 16, 0), (None, [1.0] * 16, 0), (20, rows[20][1], 0)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, rank int")
    got = N.search(df, shard=128, breadth=5.0, n_pivots=64, prefix=32).collect()
    x = np.array(vectors)
    hits = 0
    for q in range(0, 400, 20):
        score = x @ x[q]
        score[q] = -np.inf
        order = np.lexsort((np.arange(400), -score))[:20]
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, 21)) and q not in {r.vec_id for r in mine}
        assert np.allclose([r.score for r in mine], [score[r.vec_id] for r in mine])
        assert sorted(mine, key=lambda r: (-r.score, r.vec_id)) == mine or np.allclose(np.diff([r.score for r in mine]).clip(min=0), 0)
        hits += len({r.vec_id for r in mine} & set(order.tolist()))
    assert hits / 400 >= 0.9 and len(got) == 400


def test_neighbours_of_unequal_lengths(spark):
    r = np.random.default_rng(12)
    v = r.normal(size=(2000, 16)) * np.exp(r.normal(scale=0.5, size=(2000, 1)))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = N.search(df, n_pivots=128, prefix=32, breadth=6.7, top=10).collect()
    hits = 0
    for q in range(0, 2000, 20):
        score = v @ v[q]
        score[q] = -np.inf
        hits += len(set(np.argsort(-score)[:10]) & {x.vec_id for x in got if x.query_id == q})
    assert hits >= 0.9 * 1000


def recall(spark, vectors, df):
    got = {}
    for r in N.search(df).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = total = 0
    for q in range(0, len(vectors), 20):
        score = vectors @ vectors[q]
        score[q] = -np.inf
        hits += len(set(np.argsort(-score)[:20].tolist()) & got[q])
        total += 20
    return hits / total


def test_recall_of_several_shards_with_the_given_parameters(spark):
    v = np.random.default_rng(3).normal(size=(17_000, 32))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame(pd.DataFrame({"vec_id": range(len(v)), "embedding": v.tolist()}), "vec_id long, embedding array<double>")
    assert N.candidates_of(17_000, 3) * 3 < 0.05 * 17_000
    assert N.candidates_of(10**9, 10**9 // N.SHARD) * (10**9 // N.SHARD) < 0.001 * 10**9
    assert recall(spark, v, df) >= 0.9


def test_recall_on_given_vectors(spark):
    path = "/root/testdata/sf0.1/embeddings.parquet"
    if not os.path.exists(path):
        pytest.skip("no test data")
    rows = pq.read_table(path).sort_by("vec_id")
    assert rows["vec_id"].to_pylist() == list(range(rows.num_rows))
    assert recall(spark, np.array(rows["embedding"].to_pylist(), float), spark.read.parquet(path)) >= 0.9


def test_few_candidates_and_ties(spark):
    df = spark.createDataFrame([(20, [1.0, 0.0]), (7, [1.0, 0.0]), (3, [1.0, 0.0]), (40, [0.0, 1.0])], "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in N.search(df).collect())
    assert got == [(20, 1, 3, 1.0), (20, 2, 7, 1.0), (20, 3, 40, 0.0), (40, 1, 3, 0.0), (40, 2, 7, 0.0), (40, 3, 20, 0.0)]
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert N.search(empty).count() == 0
    assert N.search(spark.createDataFrame([(20, [1.0])], "vec_id long, embedding array<double>")).count() == 0


# tool links

TOOLS = [("add", "a", "integer", True), ("add", "b", "number", False), ("say", "text", "string", True)]


def message(conv, turn, calls=None, result=None, text=None):
    if calls is not None:
        return conv, turn, "assistant", json.dumps({"tool_calls": [{"id": i, "name": n, "arguments": a} for i, n, a in calls]}), 1
    if result is not None:
        return conv, turn, "tool", json.dumps({"tool_call_id": result[0], "content": result[1]}), 1
    return conv, turn, "user", text, 1


def link(spark, messages):
    df = spark.createDataFrame(messages, "conv_id long, turn long, role string, text string, key int")
    return T.link(df, spark.createDataFrame(TOOLS, "tool string, property string, type string, required boolean")).orderBy("conv_id", "position").collect()


def test_links_order_and_validation(spark):
    got = link(spark, [
        message(1, 0, text="hi"), message(1, 1, [("c2", "say", {"text": "$c1"}), ("c1", "add", '{"b": 1.5, "a": 1}')]), message(1, 2, result=("c1", "2.5 \"é\"")), message(1, 3, result=("c1", "later")),
        message(2, 1, [("x", "say", {"text": "$y"}), ("y", "say", {"text": "$x"}), ("z", "add", {"a": "no", "q": 1}), ("w", "none", {}), ("v", "add", "[1]"), (None, "say", {"text": ""})]),
        message(3, 1, [("k", "add", {})]), message(3, 1, [("k", "add", {})]), message(None, 1, [("n", "say", {"text": "x"})]), (4, 1, "assistant", None, 1), (4, 2, "assistant", "not json", 1), (4, 3, "tool", "{", 1),
    ])
    by = {(r.conv_id, r.call_id): r for r in got}
    assert [r.call_id for r in got if r.conv_id == 1] == ["c1", "c2"]
    assert by[1, "c1"].json == '{"arguments":{"a":1,"b":1.5},"id":"c1","name":"add","result":"2.5 \\"é\\""}' and by[1, "c1"].linked and by[1, "c1"].valid
    assert by[1, "c2"].json == '{"arguments":{"text":"$c1"},"id":"c2","name":"say","result":null}' and not by[1, "c2"].linked
    assert by[2, "x"].errors == by[2, "y"].errors == "cycle" and [r.call_id for r in got if r.conv_id == 2][-2:] == ["x", "y"]
    assert by[2, "z"].errors == "type:a,unknown:q" and by[2, "w"].errors == "tool" and by[2, "v"].errors == "json" and by[2, None].valid
    assert by[3, "k"].errors == "missing:a" and len([r for r in got if r.conv_id == 3]) == 1
    assert by[None, "n"].valid and not [r for r in got if r.conv_id == 4]
    assert [r.position for r in got if r.conv_id == 2] == list(range(6))


def test_chains_against_the_order(spark):
    n = 12
    calls = [(f"c{i}", "say", {"text": f"$c{i + 1}"} if i < n - 1 else {"text": "end"}) for i in range(n)]
    got = link(spark, [message(1, i, [c]) for i, c in enumerate(calls)])
    assert [r.call_id for r in got] == [f"c{i}" for i in reversed(range(n))]


def test_calls_that_differ_in_nulls_are_different_calls(spark):
    got = link(spark, [message(None, 1, [("a", "say", {"text": "x"})]), message(1, None, [("a", "say", {"text": "x"})]), message(7, 1, [(None, "say", {"text": "x"})]), message(7, 1, [("say", None, {"text": "x"})]), message(7, 1, [("say", None, {"text": "x"})])])
    assert sorted((r.conv_id or 0, r.call_id or "", r.name or "") for r in got) == [(0, "a", "say"), (1, "a", "say"), (7, "", "say"), (7, "say", "")]


def test_components_larger_than_one_aggregation(spark, monkeypatch):
    def messages(n):
        out = []
        for conv in range(3):  # reversed chains, a fork, and a circle with a call behind it
            out += [message(conv, i, [(f"c{i}", "say", {"text": f"$c{i + 1}"})]) for i in range(n)]
            out += [message(conv, 100, [("f", "add", {"a": "$g", "b": "$h"}), ("g", "say", {"text": "$h"}), ("h", "say", {"text": "end"}), ("o", "say", {"text": "$o"}), ("p", "say", {"text": "$q"}), ("q", "say", {"text": "$p"}), ("r", "say", {"text": "$q"})])]
        return out

    want = [f"c{i}" for i in reversed(range(20))] + ["h", "g", "f", "o", "p", "q", "r"]
    for local in (1024, 8):
        monkeypatch.setattr(T, "LOCAL", local)
        got = link(spark, messages(20))
        for conv in range(3):
            own = [r for r in got if r.conv_id == conv]
            assert [r.call_id for r in own] == want, local
            assert {r.call_id for r in own if "cycle" in r.errors} == {"o", "p", "q", "r"}


def test_orders_of_random_needs(spark, monkeypatch):
    """Chains, forks and circles against plain recursion, in one aggregation and in rounds."""
    rng = np.random.default_rng(6)
    seqs, needs = {}, []
    for conv in range(4):
        for i in range(60):
            seqs[f"{conv}-{i}"] = i
            for on in rng.choice(60, size=rng.choice([0, 1, 1, 1, 2]), replace=False):
                if conv < 2 and on > i or conv >= 2 and rng.random() < 0.7:  # the first two have no circles
                    needs.append((conv or None, f"{conv}-{i}", f"{conv}-{on}"))
    of = {k: [o for _, a, o in needs if a == k] for k in seqs}

    def place(key, path=()):
        if key in path:
            return None
        below = [place(o, (*path, key)) for o in of[key]]
        return None if None in below else max([(seqs[key], 0), *((a, s + 1) for a, s in below)])

    want = {k: p for k in seqs if (p := place(k))}
    assert 0 < len(want) < len(seqs)
    calls, edges = spark.createDataFrame(list(seqs.items()), "key string, seq long"), spark.createDataFrame(needs, "conv_id long, key string, on string")
    for local in (1024, 4):
        monkeypatch.setattr(T, "LOCAL", local)
        assert {r.key: (r.place.seq, r.place.step) for r in T.places(calls, edges).collect()} == want, local


def test_long_chains_take_few_rounds(spark, monkeypatch):
    monkeypatch.setattr(T, "LOCAL", 4)
    rounds, write = [], T.materialize
    for n in (8, 600):
        names = []
        monkeypatch.setattr(T, "materialize", lambda df, name, names=names: names.append(name) or write(df, name))
        calls = spark.createDataFrame([(f"c{i}", i) for i in range(n)], "key string, seq long")
        needs = spark.createDataFrame([(1, f"c{i}", f"c{i + 1}") for i in range(n - 1)], "conv_id long, key string, on string")
        assert {(r.key, r.place.seq, r.place.step) for r in T.places(calls, needs).collect()} == {(f"c{i}", n - 1, n - 1 - i) for i in range(n)}
        rounds.append(len(names))
    assert rounds[1] <= rounds[0] + 8


def test_conversations_as_messages(spark):
    rows = [(1, 0, "system", "be good"), (1, 1, "user", 'a "b"'), (1, 2, "assistant", "c"), (1, 3, "user", None), (2, 0, "assistant", "alone"), (None, 0, "user", "x")]
    schemas = spark.createDataFrame([("answer", "prompt", "string", True), ("answer", "turn", "integer", True), ("answer", "after", "string", False), ("configure", "instruction", "string", True)], "tool string, property string, type string, required boolean")
    got = T.link(T.as_messages(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")), schemas).orderBy("conv_id", "position").collect()
    assert [(r.conv_id, r.position, r.name, r.linked, r.errors) for r in got] == [(None, 0, "answer", False, ""), (1, 0, "configure", False, ""), (1, 1, "answer", True, ""), (1, 2, "answer", False, "missing:prompt")]
    assert got[2].json == '{"arguments":{"prompt":"a \\"b\\"","turn":1},"id":"c1-1","name":"answer","result":"c"}'
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert T.link(T.as_messages(empty), schemas).count() == 0
