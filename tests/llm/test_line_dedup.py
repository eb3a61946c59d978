from collections import defaultdict

from plinth.llm import line_dedup as L


def brute(rows):
    """rows: (doc_id, text, source)."""
    sites, first = defaultdict(set), {}
    for d, t, s in rows:
        for p, x in enumerate(t.split("\n") if t is not None else []):
            key = x.strip(" \t\n\v\f\r")
            if key:
                sites[key].add(s)
                first[key] = min(first.get(key, (d, p)), (d, p))
    out = {}
    for d, t, s in rows:
        if t is None:
            out[d] = None
            continue
        keep = []
        for p, x in enumerate(t.split("\n")):
            key = x.strip(" \t\n\v\f\r")
            if not (len(sites.get(key, ())) >= L.MIN_SITES and first[key] != (d, p)):
                keep.append(x)
        out[d] = "\n".join(keep)
    return out


def corpus():
    rows = []
    for k in range(60):
        own = [f"this line number {k} {j} is my own" for j in range(3)]
        if k % 3 != 1:
            own.insert(1, "  subscribe to our weekly letter now ")
        if k % 3 == 0:
            own.append("short line")
        if k % 10 < L.MIN_SITES - 1:
            own.append("only on a few sites of all")
        rows.append((k, "\n".join(own), f"s{k % 10}"))
    rows += [(100, None, "s1"), (101, "", "s2"), (102, "\n\n", None)]
    return rows


def test_equals_brute_force(spark):
    rows = corpus()
    got = {r["doc_id"]: r for r in L.line_dedup(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    want = brute(rows)
    assert {d: r["text"] for d, r in got.items()} == want
    assert sum(r["n_removed"] for r in got.values()) == 58
    assert got[100]["n_lines"] == 0 and got[101]["n_lines"] == 1 and got[102]["n_lines"] == 3


def test_near_threshold_lines_are_counted_exactly(spark):
    line = "exactly at the threshold of sites"
    for sites, cut in ((L.MIN_SITES - 1, 0), (L.MIN_SITES, L.MIN_SITES - 1), (L.MIN_SITES + 1, L.MIN_SITES)):
        df = spark.createDataFrame([(k, line, f"s{k}") for k in range(sites)], "doc_id long, text string, source string")
        assert L.line_dedup(df).agg({"n_removed": "sum"}).first()[0] == cut


def test_edge_rows(docs, no_docs):
    out = L.dedup_documents(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    same = {(r["doc_id"], r["text"]) for r in docs.collect()}
    assert {(r["doc_id"], r["text"]) for r in out.collect()} == same
    assert L.dedup_documents(no_docs).count() == 0 and L.line_dedup(no_docs).count() == 0
