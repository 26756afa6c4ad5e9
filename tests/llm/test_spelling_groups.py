import re
import zlib
from collections import Counter

from daftar.llm import spelling_groups


def brute_counts(docs, slip=spelling_groups.SLIP):
    out = Counter()
    for r in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", r["text"] or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if r['doc_id'] is None else r['doc_id']}:{run}".encode())
            if h % slip == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= spelling_groups.MIN_LETTERS and n >= spelling_groups.MIN_COUNT}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts):
    near = {w: [x for x in counts if abs(len(x) - len(w)) < 2 and one_edit(w, x)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best and counts[best] >= spelling_groups.RATIO * counts[w] else None
    out = []
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, counts[w], len(near[w]), counts.get(form[w])))
    return sorted(out, key=str)


def found(df):
    return sorted(((r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()), key=str)


def test_words_forms_and_roots(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("doc_id < 40")
    got = found(spelling_groups.group_spellings(docs))
    assert got == brute(brute_counts(docs.collect()))


def test_runs_of_equal_letters_chains_and_ties(spark):
    """Each deletion in a run of equal letters is one pair; chains lead to their end; ties go to the smaller word."""
    counts = {"aaaaaa": 5, "aaaaaaa": 30, "aaaaaaaa": 900, "baaaaaa": 900, "llaaama": 7, "lllaama": 7, "llaama": 40, "zebràs": 5, "zebras": 25, "zebrasÿ": 25}
    docs = spark.createDataFrame([(i, w) for i, w in enumerate(w for w, n in counts.items() for _ in range(n))], "doc_id long, text string")
    got = found(spelling_groups.group_spellings(docs, slip=10**9))
    assert got == brute(counts)
    roots = {r[0]: r[2] for r in got}
    assert roots["aaaaaa"] == "baaaaaa" and roots["aaaaaaa"] == "aaaaaaaa"


def test_odd_rows(odd_docs, no_docs):
    assert found(spelling_groups.group_spellings(odd_docs, min_count=1)) == brute({w: n for w, n in _all(odd_docs.collect()).items()})
    assert found(spelling_groups.group_spellings(no_docs)) == []


def _all(rows):
    least, spelling_groups.MIN_COUNT = spelling_groups.MIN_COUNT, 1
    try:
        return brute_counts(rows)
    finally:
        spelling_groups.MIN_COUNT = least
