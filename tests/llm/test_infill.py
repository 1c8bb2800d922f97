"""Fill-in-the-middle: selects against a plain list of boundaries, exact restoring."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from assaybook.llm import infill
from assaybook.llm.infill import ArrayContainer, BitmapContainer, BoundarySet, RunContainer, boundaries, draws, fill_in_middle, infill_digests, restore, transform


@pytest.mark.parametrize(
    ("values", "kind"),
    [
        (range(0, 65536, 97), ArrayContainer),
        (range(0, 65536, 2), BitmapContainer),
        (range(65536), RunContainer),
        ([*range(10, 5000), *range(6000, 65536)], RunContainer),
        ([65535], ArrayContainer),
    ],
)
def test_containers(values, kind):
    found = BoundarySet()
    found.add_chunk(2, np.array(values))
    found.add_chunk(7, np.array([5]))
    assert type(found.containers[0]) is kind and len(found) == len(values) + 1
    assert found.select(*range(len(found))) == [131072 + v for v in values] + [7 * 65536 + 5]
    assert kind is not BitmapContainer or found.containers[0].nbytes < 9000
    with pytest.raises(IndexError):
        found.select(len(found))


def offsets(text: str, unit: str) -> list[int]:
    out = []
    for i in range(len(text)):
        before = text[i - 1] if i else "\n"
        blank = lambda c: c in " \t\n\v\f\r"
        if i == 0 or unit == "char" or (unit == "line" and before == "\n") or (unit == "word" and blank(text[i]) and not blank(before)):
            out.append(len(text[:i].encode()))
    return [*out, len(text.encode())]


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("ab \n\té世\U0001f642"), max_size=60), st.sampled_from(["char", "word", "line"]), st.sampled_from([0, 16, 65520, 65536, 70000]))
def test_boundaries(text, unit, pad):
    text = "x" * pad + text
    found = boundaries(np.frombuffer(text.encode(), dtype=np.uint8), unit)
    want = offsets(text, unit) if pad < 100 else None
    if want is not None:
        assert found.select(*range(len(found))) == want
    else:
        assert found.select(len(found) - 1) == [len(text.encode())]
        if unit == "char":
            assert len(found) == len(text) + 1 and found.select(len(text) // 2, len(text) - 1) == [len(text[: len(text) // 2].encode()), len(text[:-1].encode())]


def test_large_text_of_all_container_kinds():
    text = "a" * 70_000 + "é" * 70_000 + "世a" * 40_000
    found = boundaries(np.frombuffer(text.encode(), dtype=np.uint8))
    assert {type(c) for c in found.containers} == {RunContainer, BitmapContainer}
    at = np.cumsum([0] + [len(c.encode()) for c in text])
    for k in [*range(0, len(text) + 1, 997), len(text)]:
        assert found.select(k) == [at[k]]


def plainly(doc_id, text):
    """The rule written out over code points."""
    h = hashlib.sha256(f"1:{doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, z = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[:a], text[a:z], text[z:]
    return (n, "spm", a, z - a, f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (n, "psm", a, z - a, f"<P>{p}<S>{s}<M>{m}")


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 10**9), st.text(st.sampled_from("a<SPM> é世\U0001f642\n"), max_size=40))
def test_transform_and_restore(doc_id, text):
    n, form, prefix, middle, output = transform(text.encode(), draws(doc_id))
    assert (n, form, prefix, middle, output.decode()) == plainly(doc_id, text)
    assert restore(output, form).decode() == text


def test_frame(spark):
    texts = ["", None, "é" * 500, "a <P> b", "<<S", "x" * 200_000 + "世", "M>", "line\nline\n"] * 6
    rows = [(i if i != 3 else None, t, i, "o") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n long, output string").repartition(3)
    made = {r.doc_id: r for r in fill_in_middle(df).collect()}
    assert {r.form for r in made.values()} == {"plain", "psm", "spm"}
    for i, t, *_ in rows:
        want = plainly("" if i is None else i, t or "")
        r = made[i]
        assert (r.n, r.form, r.prefix_units, r.middle_units, r.output) == want
    digests = {r.doc_id: r for r in infill_digests(fill_in_middle(df)).collect()}
    for i, t, *_ in rows:
        assert digests[i].restored_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
        assert digests[i].output_sha256 == hashlib.sha256(made[i].output.encode()).hexdigest()
    assert fill_in_middle(df.limit(0)).count() == 0
    twice = spark.createDataFrame([("k", "one text"), ("k", "another text")], "doc_id string, text string")
    assert fill_in_middle(twice, plain=0).select("n").distinct().count() == 2


def test_words_and_lines(spark):
    df = spark.createDataFrame([(i, "one two\nthree four\nfive six\n") for i in range(60)], "doc_id long, text string")
    for unit, most in (("word", 7), ("line", 3)):
        for r in fill_in_middle(df, unit=unit, plain=0).collect():
            assert r.n == most and restore(r.output.encode(), r.form).decode() == "one two\nthree four\nfive six\n"
            prefix = r.output.split("<P>")[1].split("<")[0] if r.form != "plain" else ""
            assert prefix == "" or (prefix.endswith("\n") if unit == "line" else prefix[-1].isalpha() or prefix.endswith("six\n"))


def test_no_python_in_restoring(spark):
    plan = infill.restore_texts(spark.createDataFrame([("a", "plain")], "output string, form string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InArrow" not in plan
