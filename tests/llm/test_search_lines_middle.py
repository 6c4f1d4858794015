"""Operators 11 to 13: brute-force versions, SQL, round trips and odd rows."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rankfile.llm import lines, middle, search

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows, clash=()):
    df = spark.createDataFrame([(i, t, "en", "s", len(t) if t is not None else None) for i, t in rows], DOCS)
    return df.withColumns({c: F.lit(7) for c in clash})


# ranked search
TERM = re.compile("[^\\x00-\\x2f\\x3a-\\x40\\x5b-\\x60\\x7b-\\x7f]+")


def plain_terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_search(rows, items, k):
    held = [(i, Counter(plain_terms(t))) for i, t in rows]
    n_docs = sum(1 for _, c in held if c)
    length = sum(sum(c.values()) for _, c in held)
    df = Counter(w for _, c in held for w in c)
    out = []
    for item, text in items:
        found = []
        for i, c in held:
            if not c:
                continue
            m = 100 - 75 + (75 * sum(c.values()) * n_docs) // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 8 * m)) for w in plain_terms(text) if c[w])
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, f[3], -f[0]) for r, f in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("shard", "opened"), [(1 << 14, 256), (7, 2)])
def test_search_against_brute_force(spark, monkeypatch, shard, opened):
    monkeypatch.setattr(search, "SHARD_DOCS", shard)
    monkeypatch.setattr(search, "OPEN", opened)
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(60)] + ["É", "Straße", "ﬁ", "x1y"]
    text = lambda n: " ".join(words[int(len(words) * x**3)] for x in rng.random(n))
    rows = [(i, text(int(rng.integers(0, 60)))) for i in range(200)]
    rows += [(500 + i, rows[3][1]) for i in range(30)]  # copies: equal scores
    rows += [(900, None), (901, ""), (902, "!!! ..."), (903, "W1 w1-W1_w1"), (904, text(20_000)), (None, rows[3][1]), (3, rows[5][1])]
    items = [(i, text(12)) for i in range(15)] + [(99, None), (98, "?"), (97, "nosuchterm"), (3, "w1 w1 W1 É é"), (3, "w1"), (None, "straße Straße")]
    d = docs(spark, rows, clash=("terms", "counts", "kind", "n", "q", "rank", "score")).repartition(5)
    q = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    got = sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in search.search(d, q).collect()), key=repr)
    assert got == plain_search(rows, items, 10)
    assert search.search(d.limit(0), q).count() == search.search(d, q.limit(0)).count() == search.search(d, q.where("item_id = 98")).count() == 0


def test_search_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(search, "BLOCK", 10)
    rows, items = [(i, f"alpha beta{i % 3} gamma") for i in range(20)], [(1, "beta1 alpha"), (2, "beta2"), (3, "gamma beta0 x")]
    got = sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in search.search(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()), key=repr)
    assert got == plain_search(rows, items, 10)


def test_tree_bounds_and_skips():
    rng = np.random.default_rng(2)
    n, per = 1000, 40
    doc, impact, starts = [], [], [0]
    for _ in range(per):
        some = rng.choice(n, 300, replace=False)
        x = np.sort(rng.integers(1, 1000, 300))[::-1]
        doc.append(some), impact.append(x), starts.append(starts[-1] + 300)
    doc, impact, starts = np.concatenate(doc), np.concatenate(impact).astype(np.int32), np.array(starts)
    tree = search.Tree(doc, impact, n)
    weight = rng.integers(1, 50, per)
    total = np.zeros(n, np.int64)
    np.add.at(total, doc, np.repeat(weight, 300) * impact)
    got = search.best_of(tree, np.arange(n), weight, starts[:-1], starts[1:], 10, [])
    order = np.lexsort((np.arange(n), -total))[:10]
    assert got == [(-int(total[i]), int(i)) for i in order]
    # a better list from elsewhere: nothing here can enter
    other = [(-(10**9), -5)] * 10
    assert search.best_of(tree, np.arange(n), weight, starts[:-1], starts[1:], 10, other) == other


# line deduplication
def plain_lines(rows, least=40, documents=5):
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    held = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= least:
                held.setdefault(key(x), set()).add(-(2**63) if i is None else i)
    gone = {k: max(v) for k, v in held.items() if len(v) >= documents}
    out = []
    for i, t in rows:
        all_lines = (t or "").split("\n")
        stay = [x for x in all_lines if key(x) not in gone or gone[key(x)] == (-(2**63) if i is None else i)]
        out.append((i, len(all_lines), len(all_lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    return sorted(out, key=repr)


A, B = "The common licence line that many documents hold, really", "Été ÀÉÎ — eine zweite lange Zeile mit Umlauten äöü und mehr"
LINE_ROWS = [(i, f"own line of document {i} which is long enough to count\n  {A.upper() if i % 2 else A}\t\nshort\n{B}") for i in range(12)]
LINE_ROWS += [(20, None), (21, ""), (22, "\n\n"), (23, f"{A}\n{A}\n{B}\n"), (None, f"{A}\nx"), (None, f"{A}"), (24, "\n".join([A, "y"] * 4000)), (5, LINE_ROWS[5][1]), (6, f"{A}\nanother text of a document whose id comes twice"), (25, B.replace("É", "é"))]
LINE_ROWS += [(40 + i, "four documents hold this line, so that it stays in each of them") for i in range(4)] + [(50, "x" * 39), (51, "line sep inside a line that is long enough \x85 to count \x1c")]


@pytest.mark.parametrize(("batches", "fanout"), [(4, 2), (1, 2), (7, 3)])
def test_lines_against_brute_force(spark, batches, fanout):
    d = docs(spark, LINE_ROWS, clash=("id", "t", "key", "place", "n", "top", "batch", "n_lines", "_l")).repartition(3)
    got = lines.deduplicated(d, batches=batches, fanout=fanout)
    assert {"id", "key", "lang"} <= set(got.columns)
    out = [(r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in got.collect()]
    assert sorted(out, key=repr) == plain_lines(LINE_ROWS)
    assert lines.deduplicated(d.limit(0)).count() == 0


def test_lines_query_runs_no_python(spark):
    plan = lines.op12_lines(docs(spark, LINE_ROWS))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("rankfile_runs_")]


def test_runs_hold_each_key_once_and_merge(spark):
    folder = lines.shared_folder(spark, "test")
    runs = lines.Runs(spark, folder, 3, 2)
    rng, want = np.random.default_rng(1), {}
    for b in range(5):
        keys = {int(k): (int(rng.integers(1, 4)), 10 * b + int(k) % 10) for k in rng.integers(0, 30, 25)}
        for k, (n, top) in keys.items():
            old = want.get(k, (0, -1))
            want[k] = (old[0] + n, max(old[1], top))
        runs.add(spark.createDataFrame([(bytes([k]), n, top) for k, (n, top) in keys.items()], "key binary, n long, top long"))
        own = [bytes(r.key) for t in runs._tables() for r in spark.table(t).where("not known").collect()]
        assert sorted(own) == sorted(bytes([k]) for k in want)  # the anti-join: a key is one run's own
    assert [len(x) for x in runs.levels] == [1, 0, 1]
    assert {r.key[0]: (r.n, r.top) for r in runs.counts().collect()} == want
    table = spark.table(runs._tables()[0])
    joined = table.hint("merge").join(table.select("key", F.lit(1).alias("x")).hint("merge"), "key")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in joined
    runs.close()


# fill in the middle
def plain_middle(i, text):
    t = text or ""
    u = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", t)
    h = hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    pre, mid, suf = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not t or re.search("<[PSM]>", t) or h[2] % 100 >= 50:
        return len(u), "plain", None, None, t, t
    if h[3] % 100 < 80:
        return len(u), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}", t
    return len(u), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}", t


def test_middle_against_brute_force(spark):
    rng = np.random.default_rng(3)
    parts = ["a", "é", "\U0001f600", " ", "\n", "\t\x0b", "\x85", "　", "word", "<", "S>", "<P", ">", "P>", "<M"]
    rows = [(i, "".join(parts[k] for k in rng.integers(0, len(parts), int(rng.integers(0, 40))))) for i in range(1200)]
    rows += [(2000 + i, t) for i, t in enumerate([None, "", " ", "  \n ", "x", "<P>", "a<S>b", "<M", "<", "y " * 500_000, "z" * 300_000, "no end space ", " begin"] * 4)]
    rows += [(None, "text without an id, to be cut by the empty string"), (7, rows[7][1]), (-5, "a b c d")]
    d = docs(spark, rows, clash=("n", "form", "output", "_k", "h")).repartition(4)
    got = middle.restored(middle.transformed(d), out="back")
    assert {"lang", "h", "_k", "text"} <= set(got.columns)
    found = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in got.collect()), key=repr)
    assert found == sorted(((i, *plain_middle(i, t)) for i, t in rows), key=repr)
    assert {r[2] for r in found} == {"plain", "psm", "spm"}
    assert middle.op13_middle(d.limit(0)).count() == 0


def test_rates_are_limits(spark):
    d = docs(spark, [(i, "one two three four") for i in range(50)])
    assert {r.form for r in middle.transformed(d, fim_rate=0).collect()} == {"plain"}
    assert {r.form for r in middle.transformed(d, fim_rate=100, spm_rate=0).collect()} == {"psm"}


def test_sentinels_do_not_cross_texts():
    data, offsets = middle.buffers_of(pa.array(["<", "S>", "a<M>", "<P", ">"]))
    assert middle.sentinels_at(data, offsets).tolist() == [4]
