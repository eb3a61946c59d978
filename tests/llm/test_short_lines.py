from plinth.llm import line_dedup as L


def test_the_stage_cuts_short_lines_by_their_sites_alone(spark):
    rows = [(k, f"a line of my own, number {k}\nLes.\n\n  All rights reserved. \n{'few' if k < L.MIN_SITES - 1 else 'end ' + str(k)}", f"s{k}") for k in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r["text"].split("\n") for r in L.dedup_documents(df).collect()}
    assert got[0] == rows[0][1].split("\n")
    for k, t, _ in rows[1:]:
        assert got[k] == [x for x in t.split("\n") if x.strip() not in ("Les.", "All rights reserved.")]
