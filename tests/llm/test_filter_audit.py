from itertools import permutations

from daftar.llm import filter_audit

COLUMNS = "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley".split()


def brute(docs, labels):
    """The audit by running every order over every document."""
    space = filter_audit.SPACE
    info = {}
    for r in labels:
        good, toxic = info.get(r["doc_id"], (False, False))
        info[r["doc_id"]] = (good or r["quality"] == 1, toxic or r["toxic"] == 1)
    rows = []
    for r in docs:
        text = r["text"] or ""
        words = "".join(" " if c in space else c for c in text).split(" ")
        words = [w for w in words if w]
        fails = "A" * (len(words) < 100) + "B" * (100 * len(set(words)) < 80 * len(words))
        fails += "C" * (100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text)) + "D" * any(c in "#$%&*|" for c in text)
        smaller = any(o["doc_id"] is not None and r["doc_id"] is not None and o["doc_id"] < r["doc_id"] and (o["text"] or "") == text for o in docs)
        rows.append((r["lang"] or "", fails + "E" * smaller, *(info.get(r["doc_id"], (False, False)) if r["doc_id"] is not None else (False, False))))
    out, total = [], {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        for order in permutations("ABCDE"):
            left = own
            for k, f in enumerate(order):
                gone = [r for r in left if f in r[1]]
                before = [r for r in own if f in r[1] and set(order[:k]) & set(r[1])]
                left = [r for r in left if f not in r[1]]
                total[part, f] = total.get((part, f), 0) + len(gone)
                out.append([part, "".join(order), k + 1, len(left), len(gone), len(before), sum(r[1] == f for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone)])
    return sorted((*r, total[r[0], r[1][r[2] - 1]]) for r in out)


def found(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def test_all_orders_against_runs(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet").filter("doc_id < 60 or text is null"), spark.read.parquet(f"{sf}/labels.parquet")
    assert found(filter_audit.audit_filters(docs, labels)) == brute(docs.collect(), labels.collect())


def test_odd_rows(odd_docs, labels, no_docs):
    assert found(filter_audit.audit_filters(odd_docs, labels)) == brute(odd_docs.collect(), labels.collect())
    assert found(filter_audit.audit_filters(no_docs, labels)) == []


def test_null_part_and_copies_without_ids(spark, labels):
    docs = spark.createDataFrame([(2, "x", None), (1, "x", ""), (1, "x", "fr"), (None, "x", "fr"), (7, None, "fr"), (8, "", "fr")], "doc_id long, text string, lang string")
    assert found(filter_audit.audit_filters(docs, labels)) == brute(docs.collect(), labels.collect())


def test_paths_of_the_lattice():
    forward, backward = filter_audit.path_counts(5)
    assert forward[31] == backward[0] == 120
    assert all(sum(forward[s] * backward[s] for s in range(32) if s.bit_count() == k) == 120 for k in range(6))
