import collections
import random

from corpusloom.llm import lines
from tests.llm.helpers import doc, groups, table


def line_set(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text.strip("\t\n\x0b\x0c\r "))
    if not text:
        return frozenset()
    return frozenset(text[i : i + 5] for i in range(max(1, len(text) - 4)))


def expected(rows):
    sets = {(d, n): line_set(line) for d, text, *_ in rows if text is not None
            for n, line in enumerate(text.split("\n"))}
    first = groups(sets)
    out = {}
    for d, text, *_ in rows:
        if text is None:
            out[d] = None
        else:
            out[d] = "\n".join(line for n, line in enumerate(text.split("\n"))
                               if first[d, n] == (d, n))
    return out


def sentence(rng, n):
    return " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randrange(2, 9)))
                    for _ in range(n))


def test_lines_equal_brute_force(spark):
    rng = random.Random(8)
    common = [sentence(rng, rng.randrange(2, 40)) for _ in range(12)]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(rng.randrange(1, 7)):
            kind = rng.random()
            if kind < 0.4:
                line = list(rng.choice(common))
                for _ in range(rng.choice([0, 0, 1, 2])):
                    line[rng.randrange(len(line))] = rng.choice("xyzXYZ")
                parts.append(rng.choice(["", "  ", "\t"]) + "".join(line) + rng.choice(["", "\r"]))
            elif kind < 0.5:
                parts.append(rng.choice(["", "  ", "\t"]))
            elif kind < 0.6:
                parts.append(rng.choice(["short", "Short ", "é", "ok ok"]))
            else:
                parts.append(sentence(rng, rng.randrange(3, 30)))
        rows.append(doc(i, "\n".join(parts)))
    rows += [doc(100, None), doc(101, ""), doc(102, "\n \n"), doc(103, common[0] * 3000)]
    got = {r.doc_id: r for r in lines.dedup_lines(table(spark, rows)).collect()}
    want = expected(rows)
    assert {d: r.text for d, r in got.items()} == want
    for d, text, *_ in rows:
        full = [p for p in (text or "").split("\n") if p.strip("\t\n\x0b\x0c\r ")]
        kept = [p for p in (want[d] or "").split("\n") if p.strip("\t\n\x0b\x0c\r ")]
        assert (got[d].n_lines, got[d].n_dropped) == (len(full), len(full) - len(kept))


def test_odd_rows(spark):
    rows = [doc(5, "same line here\nother things"), doc(5, "same line here\nother things"),
            doc(None, "same line here\nthis one is new"), doc(6, "Same line here ")]
    docs = table(spark, rows).selectExpr("*", "1 AS line", "1 AS node", "7 AS n_lines", "2 AS key")
    got = lines.dedup_lines(docs).collect()
    assert collections.Counter((r.doc_id, r.text) for r in got) == collections.Counter(
        [(5, rows[0][1])] * 2 + [(None, "this one is new"), (6, "")])
    assert {r.n_lines for r in got} == {2, 1}
    kept = lines.dedup_lines(docs, drop_emptied=True)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {5, None}
    assert {r.n_lines for r in kept.collect()} == {7}
    assert lines.dedup_lines(docs.limit(0)).count() == 0


def test_a_line_of_many_documents_stays_once(spark):
    rows = [doc(i, f"own words of {i * 7919 % 1000} and {i * 104729}\nThe very same footer line.")
            for i in range(400)]
    got = lines.dedup_lines(table(spark, rows)).collect()
    assert sum("footer" in r.text for r in got) == 1
    assert "footer" in next(r.text for r in got if r.doc_id == 0)


def test_texts_that_share_an_id_lose_only_their_own_lines(spark):
    rows = [doc(1, "a dup line"), doc(None, "a dup line\nx"), doc(None, "unique text\ny"),
            doc(7, "the first of two\nshared by seven"), doc(7, "another start\nshared by seven")]
    got = lines.dedup_lines(table(spark, rows)).collect()
    left = collections.Counter(line for r in got for line in r.text.split("\n") if line)
    assert left == collections.Counter({line for _, text, *_ in rows for line in text.split("\n")})
    assert "a dup line" in next(r.text for r in got if r.doc_id == 1)


def test_planted_edits_in_lines_of_30_to_100_characters(spark):
    rng = random.Random(21)
    rows, linked = [], set()
    for i in range(240):
        size, edits = rng.randrange(30, 101), rng.choice([1, 2])
        letters = [chr(rng.choice([97 + rng.randrange(26), 0x4E00 + rng.randrange(3000)]))
                   for _ in range(size)]
        copy = list(letters)
        for place in rng.sample(range(size), edits):
            copy[place] = "#"
        rows += [doc(2 * i, "".join(letters)), doc(2 * i + 1, "".join(copy))]
        a, b = line_set(rows[-2][1]), line_set(rows[-1][1])
        if 100 * len(a & b) >= 80 * len(a | b):
            linked.add(2 * i + 1)
        if size >= 49 and edits == 1 or size >= 94:  # whatever the places of the edits
            assert 2 * i + 1 in linked
    got = lines.dedup_lines(table(spark, rows)).collect()
    assert {r.doc_id for r in got if r.n_dropped} == linked and len(linked) > 80
