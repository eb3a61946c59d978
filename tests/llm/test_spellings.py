import random
import re
import zlib
from collections import Counter

from plinth.llm import spellings


def brute(docs):
    """The definition, pair by pair."""
    seen = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c < "\x80" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            seen[run] += 1
    n = {w: k for w, k in seen.items() if len(w) >= 7 and k >= 2}

    def near(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    form, count = {}, {}
    for w in n:
        some = [v for v in n if v != w and near(v, w)]
        count[w] = len(some)
        best = min(some, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, n[w], count[w], form[w], n[form[w]] if form[w] else None, root(w)) for w in n}


def found(df):
    return {(r["word"], r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in df.collect()}


def corpus():
    rnd = random.Random(11)
    stems = ["balloon", "aaaaaaa", "committee", "naïveté", "ÉÉÉÉÉÉÉÉ", "mississippi", "parallel", "×÷ÿßàéîõ"]
    docs = []
    for k in range(60):
        out = []
        for _ in range(80):
            w = rnd.choice(stems[: 1 + k % len(stems)])
            for _ in range(rnd.choice((0, 0, 0, 0, 1, 1, 2))):
                at = rnd.randrange(len(w))
                w = rnd.choice((w[:at] + w[at + 1 :], w[:at] + rnd.choice("abÿ") + w[at:], w[:at] + rnd.choice("xa") + w[at + 1 :])) or "balloon"
            out.append(w.upper() if rnd.random() < 0.1 else w)
        docs.append((k, rnd.choice((" ", ",", "\n", "1")).join(out)))
    return docs


def test_equals_every_pair(spark):
    docs = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute(docs)
    assert any(r[3] and r[5] != r[3] for r in want) and any(r[2] > 10 for r in want)
    assert found(spellings.variants(df)) == want


def test_long_chains_of_forms(spark):
    base, text = "abcdefghij", []
    for k in range(5):
        text += ["z" * k + base[k:]] * (2 * 10**k)
    # Forms go from each word to the next; digests take some occurrences away, so figures come from the definition.
    docs = [(1, " ".join(text))]
    got = found(spellings.variants(spark.createDataFrame(docs, "doc_id long, text string")))
    assert got == brute(docs)


def test_odd_rows(spark, docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert found(spellings.variants(docs)) == brute(rows)
    assert found(spellings.variants(docs.unionAll(docs))) == brute(rows * 2)
    assert spellings.variants(no_docs).count() == 0
