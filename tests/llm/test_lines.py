"""Line dedup against plain edit distances."""

from hypothesis import given, settings
from hypothesis import strategies as st

from siltstone.llm import lines


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        corner, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            corner, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, corner + (x != y))
    return row[-1]


@settings(max_examples=400, deadline=None)
@given(st.text("abcé", max_size=12), st.text("abcé", max_size=12), st.integers(1, 3))
def test_band_agrees_with_the_whole_table(a, b, edits):
    assert lines.within(a, b, edits) == (edit_distance(a, b) <= edits)


def expected(rows):
    """Texts by brute force over all pairs of lines."""
    seen, parent = {}, {}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for doc, text in sorted(rows):
        for n, line in lines._lines(text or ""):
            seen.setdefault(line, (doc, n))
    parent.update({x: x for x in seen})
    for a in seen:
        for b in seen:
            if a < b and min(len(a), len(b)) >= lines.LEAST_CHARS and edit_distance(a, b) <= lines.EDITS:
                x, y = sorted((root(a), root(b)), key=seen.get)
                parent[y] = x
    return {
        doc: None if text is None else "\n".join(
            x for n, x in enumerate(text.split("\n")) if not x.strip(" \t\x0b\x0c\r") or seen[root(x)] == (doc, n))
        for doc, text in rows}


def test_texts_as_by_brute_force(documents):
    base = "a line that is long enough to be edited"
    rows = [
        (1, f"{base}\nshort\n\nown line of the first document"), (2, f"{base}\n{base}s\nshort"), (3, base.replace("long", "lung") + "\nshore"),
        (4, "Xa line that is long enough to be editedXX"), (5, None), (6, ""), (7, "\n \n"), (8, "x" * 5000 + "\n" + "x" * 4999 + "y"),
        (9, "own line of the first document, é\nown line of the first document, ê")]
    rows += [(100 + i, f"common line of very many documents\nline {i * 7919} of document {i * 104729}") for i in range(60)]
    got = {r["doc_id"]: r["text"] for r in lines.cleaned(documents(rows)).collect()}
    assert got == expected(rows)


def test_counts_rows_and_clashing_columns(spark, documents):
    docs = documents([(1, "same line\nother"), (2, "same line"), (None, "same line"), (2, "same line")]).selectExpr("*", "'x' AS n_lines", "1 AS gone", "2 AS h1")
    done = lines.cleaned(docs)
    assert done.columns[:8] == docs.columns and done.columns[8:] == ["_n_lines", "n_exact", "n_near"]
    got = sorted((str(r["doc_id"]), r["text"], r["_n_lines"], r["n_exact"]) for r in done.collect())
    assert got == [("1", "same line\nother", 2, 0), ("2", "", 1, 1), ("2", "", 1, 1), ("None", "same line", 0, 0)] or got[3][1] == "same line"
    kept = lines.deduplicated(docs)
    assert kept.columns == docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "None"]


def test_empty_table(documents):
    assert lines.cleaned(documents([])).count() == 0


def test_driver_documents(spark, small, prose):
    got = {r["doc_id"]: r["text_crc32"] for r in lines.op1_segment_lines(spark, small).collect()}
    assert len(got) == len(prose)
