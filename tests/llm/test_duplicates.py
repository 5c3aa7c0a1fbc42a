"""SimHash components and line dedup against brute force, and the defined cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

xxhash = pytest.importorskip("xxhash")

from faultsieve.llm import line_winnow as L  # noqa: E402
from faultsieve.llm import shingle_join as S  # noqa: E402
from faultsieve.llm import simhash_dedup as H  # noqa: E402


def brute_print(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """Least key reachable over links of 3 bits or fewer."""
    keys = list(prints)
    root = {k: k for k in keys}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


def test_fingerprints_and_components(documents):
    random.seed(1)
    words = [f"w{i}" for i in range(400)]
    base = [" ".join(random.choices(words, k=random.choice([3, 40, 400]))) for _ in range(40)]
    texts = {i: t for i, t in enumerate(base)}
    for i in range(60):  # near copies of few documents
        w = random.choice(base[:4]).split()
        w[random.randrange(len(w))] = random.choice(words)
        texts[100 + i] = " ".join(w)
    texts |= {200: None, 201: "", 202: " \t\n", 203: "One", 204: "oNE", 205: "two words", 206: base[0].upper(), 207: "É é", 208: "a b"}
    got = {r.doc_id: r for r in H.near_duplicates(documents(texts.items())).collect()}
    prints = {k: brute_print(t) for k, t in texts.items()}
    want = brute_components(prints)
    for k in texts:
        assert got[k].fingerprint == f"{prints[k]:016x}", texts[k]
        assert got[k].component_id == want[k], k
    assert got[201].component_id == got[202].component_id == 200 and got[204].component_id == 203


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_links_of_chosen_fingerprints(spark, monkeypatch):
    monkeypatch.setattr(H, "HOT_CELL", 8)
    monkeypatch.setattr(H, "BLOCK", 16)
    random.seed(2)
    prints = set()
    for _ in range(30):
        x = random.getrandbits(64)
        prints.add(x)
        for d in (1, 2, 3, 4, 5):
            prints.add(x ^ sum(1 << b for b in random.sample(range(64), d)))
    center = random.getrandbits(64)  # a group dense enough for blocks
    for i in range(64):
        prints |= {center ^ 1 << i, center ^ 1 << i ^ 1 << (i * 7 + 3) % 64}
    prints |= {0, 1, 7, 15, (1 << 64) - 1, (1 << 64) - 2, 1 << 63, 3 << 62}
    prints = sorted(prints)
    df = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    found = {r.node: r.root for r in H.components(H.links(df)).collect()}
    want = brute_components({signed(p): p for p in prints})
    for p in map(signed, prints):
        assert found.get(p, p) == want[p]


def test_repeated_rows_null_ids_and_empty_tables(documents):
    got = H.near_duplicates(documents([(5, "a b c"), (5, "a b c"), (None, "a b c"), (None, "other text here"), (2, "x y z")])).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in got) == [(-1, -1), (-1, 5), (2, 2), (5, 5), (5, 5)]
    assert H.near_duplicates(documents([])).count() == 0
    kept = S.keep_one(documents([(5, "a b c"), (5, "a b c"), (4, "A b c"), (None, "a b c"), (2, "x y z"), (5, "another text of the same id")]))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars", "fp", "tie", "runs"]
    assert sorted((r.doc_id or -1, r.text) for r in kept.collect()) == [(-1, "a b c"), (2, "x y z"), (4, "A b c"), (5, "another text of the same id")]


def brute_lines(docs, least=50):
    """Text without any line of a run of so many words that occurs before; docs in order."""
    weigh = lambda line: max(1, len(line.encode().split()))
    runs, first, gone = {}, {}, set()
    for d in sorted(docs):
        lines = docs[d].split("\n") if docs[d] else []
        for p in range(len(lines)):
            run, n, upto = 0, 0, p
            for q in range(p, len(lines)):
                run, n = runs.setdefault((run, lines[q]), len(runs) + 1), n + weigh(lines[q])
                if n >= least and first.setdefault(run, (d, p)) != (d, p):
                    upto = q + 1
            gone |= {(d, i) for i in range(p, upto)}
    return {d: "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in gone) if t else "" for d, t in docs.items()}


def test_line_dedup_equals_brute_force(documents):
    random.seed(5)
    pool = [" ".join(random.choices("abcdefgh", k=random.choice([1, 5, 20, 60]))) for _ in range(30)] + [""]
    passage = [" ".join(f"p{i}" for i in range(55)), "tail line"]
    docs = {}
    for d in range(60):
        lines = random.choices(pool, k=random.randint(1, 12))
        if d % 4 == 0:
            at = random.randint(0, len(lines))
            lines[at:at] = passage
        docs[d] = "\n".join(lines)
    docs |= {100: docs[0], 101: "", 102: "word " * 5000, 103: "same line\n" * 100}
    rows = [*docs.items(), (104, None), (7, docs[7])]
    got = L.line_dedup(documents(rows)).collect()
    want = brute_lines(docs) | {104: ""}
    assert len(got) == len(rows)
    for r in got:
        assert r.text == want[r.doc_id], r.doc_id
    assert sum(passage[0] in r.text for r in got) == 1
    assert next(r for r in got if r.doc_id == 100).n_lines == docs[100].count("\n") + 1


def test_runs_with_different_tails_are_deleted_whole(documents):
    head = " ".join(f"h{i}" for i in range(55))
    docs = {1: f"{head}\nown ending", 2: f"start\n{head}\nshort tail\nrest", 3: f"{head}\nshort tail\nlast", 4: f"other tail\n{head}", 5: f"x y\nother tail\n{head}"}
    got = {r.doc_id: r.text for r in L.line_dedup(documents(docs.items())).collect()}
    assert got == brute_lines(docs) == {1: docs[1], 2: "start\nshort tail\nrest", 3: "last", 4: "other tail", 5: "x y"}


def _text_lines(seed, n):
    random.seed(seed)
    return [(d, "\n".join(" ".join(random.choices("abcdefghijklm", k=random.randint(3, 14))) for _ in range(40))) for d in range(n)]


def test_fingerprints_are_window_minima(documents):
    docs = documents(_text_lines(8, 30))
    want, lines = set(), {}
    for r in L._lines(docs).orderBy("doc", "pos").collect():
        lines.setdefault(r.doc, []).append((0 if r.w >= 50 else 1 if r.w >= L.SHORT else 2, r.h, r.pos, r.w))
    for d, own in lines.items():
        for p in range(len(own)):
            n, q = 0, p
            while q < len(own) and n < 50:
                n, q = n + own[q][3], q + 1
            if n >= 50:
                want.add((d, min(own[p:q])[2]))
    got = L.fingerprints(docs).collect()
    assert {(r.doc, r.pos) for r in got} == want and len(got) == len(want)
    assert len(got) < 0.4 * sum(map(len, lines.values()))
    for r in got:
        at = [(x[1], x[3]) for x in lines[r.doc]]
        assert at[r.pos] == (r.mark, r.w)
        assert [tuple(x) for x in r.left] == at[: r.pos][::-1][: len(r.left)] and [tuple(x) for x in r.right] == at[r.pos + 1 :][: len(r.right)]


def _shared_runs():
    """Documents that share runs, among them one line in many surroundings and runs that differ in one line."""
    docs = dict(_text_lines(9, 40))
    for d in range(1, 40):
        own, other = docs[d].split("\n"), docs[random.randrange(d)].split("\n")
        at, n = random.randrange(30), random.randint(2, 10)
        own[at : at + n] = other[at : at + n]
        own[::13] = ["one line that stands in all of these documents again"] * len(own[::13])
        docs[d] = "\n".join(own)
    words = lambda x, n=20: " ".join(f"{x}{i}" for i in range(n))
    docs |= {50: "\n".join([words("a"), words("b", 55), words("c")]), 51: "\n".join([words("a"), words("other", 55), words("c")])}
    return docs


@pytest.mark.parametrize("classes", [0, 2, 64])
def test_line_dedup_with_any_number_of_classes(documents, monkeypatch, classes):
    monkeypatch.setattr(L, "CLASSES", classes)
    docs = _shared_runs()
    got = {r.doc_id: r.text for r in L.line_dedup(documents(docs.items())).collect()}
    assert got == brute_lines(docs)
    assert sum(got[d] != docs[d] for d in docs) > 10


def test_fingerprints_decide(documents, monkeypatch):
    docs, find = _shared_runs(), L.fingerprints
    right = brute_lines(docs)
    assert right[51] == docs[51]
    for wrong in (F.lit(0).cast("long"), F.xxhash64("mark", "doc")):
        monkeypatch.setattr(L, "fingerprints", lambda *a, wrong=wrong: find(*a).withColumn("mark", wrong))
        got = {r.doc_id: r.text for r in L.line_dedup(documents(docs.items())).collect()}
        assert got != right
    assert got == docs  # no two documents share a fingerprint, so nothing goes


def test_pipeline_stage_keeps_columns(documents):
    long = "\n".join(" ".join(f"x{i}-{j}" for j in range(30)) for i in range(4))
    docs = documents([(1, long), (2, "own start\n" + long), (3, "own text"), (4, None), (None, "z")])
    out = L.drop_repeats(docs)
    assert out.schema == docs.schema
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[2].text == "own start" and rows[2].n_chars == 9 and rows[2].tie == 1 and rows[2].runs == 2
    assert rows[1].text == long and rows[3].text == "own text" and rows[4].text is None
    assert L.drop_repeats(documents([])).count() == 0


def brute_similar(docs):
    """The least doc_id of each document's component, linked by a Jaccard index of 0.8 or more of five-word shingles."""
    sets = {}
    for d, t in docs.items():
        words = (t or "").lower().split()
        sets[d] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    parent = {d: d for d in docs}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    links = 0
    for a in docs:
        for b in docs:
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                links += 1
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: root(d) for d in docs}, links


def test_group_of_near_copies_is_no_square(documents, spark):
    random.seed(31)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for d in range(400):
        words = list(base)
        for _ in range(random.randint(1, 4)):
            words[random.randrange(150)] = f"n{random.randint(0, 10**6)}"
        rows.append((d, " ".join(words)))
    want, links = brute_similar(dict(rows))
    kept = S.keep_one(documents(rows)).collect()
    assert sorted(r.doc_id for r in kept) == sorted({want[d] for d in want}) and links > 10_000


def test_stage_finds_all_near_copies(documents):
    import corpus_pipeline

    random.seed(11)
    docs = {}
    for i in range(40):
        words = [f"w{random.randint(0, 3000)}" for _ in range(random.choice([6, 12, 45, 150, 600]))]
        own = " ".join(words)
        for v in range(6):  # up to a similarity of about 0.6 to the first, so many lie near 0.8
            copy = list(words)
            for _ in range(random.randint(0, max(1, len(words) // 25))):
                copy[random.randrange(len(copy))] = f"n{random.randint(0, 999)}"
            docs[len(docs)] = " ".join(copy) if v else own
    notice = "this line stands in many of the documents and is no sign of a copy"
    docs |= {500 + i: f"{notice} {i} " + " ".join(f"u{i}x{j}" for j in range(random.randint(0, 12))) for i in range(60)}
    docs |= {700: None, 701: "", 702: " ", 703: "a b c", 704: "A b  c", 705: "a b d"}
    want, links = brute_similar(docs)
    assert links > 200
    keys = list(docs)
    random.shuffle(keys)
    kept = corpus_pipeline.near_dedup(None, documents([(d, docs[d]) for d in keys]).repartition(3), "").collect()
    assert sorted(r.doc_id for r in kept) == sorted(d for d in docs if want[d] == d)
    assert corpus_pipeline.near_dedup(None, documents([]), "").count() == 0
