"""Licence scan: names against a plain search, templates with key phrases, plans without Python."""

import math
import random
import re

from assaybook.llm import licenses

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(text):
    words = WORD.findall((text or "").translate(LOWER))
    found = sorted((i, label) for phrase, label in licenses.BASE.items() for k in [phrase.split()] for i in range(len(words)) if words[i : i + len(k)] == k)
    return len(words), len(found), found[0][0] if found else None, found[-1][0] if found else None, ",".join(sorted({x for _, x in found}))


ROWS = [
    (1, None), (2, ""), (3, "MIT License, mit-license; CC BY 4.0 and CC  BY-NC 4.0"), (4, "GNU General Public\nLicense é gnu general public licence"), (5, "word " * 40_000 + "Apache License"),
    (6, "x Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction."),
    (7, "x Permission is hereby granted, at no charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction."),
    (8, "Licensed under the Apache License, Version 2.0."), (9, "Licensed under the Apache License, Version 3.0."), (10, "license free software public"), (None, "Released under the MIT License."), (None, "Released under the MIT License."),
]


def test_names_and_templates(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").filter("doc_id > 20")
    df = docs.unionByName(spark.createDataFrame(ROWS, "doc_id long, text string"))
    got = licenses.scan(df)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    rows = got.collect()
    key = lambda r: repr(r)
    assert sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows), key=key) == sorted(((r.doc_id, *plain(r.text)) for r in df.collect()), key=key)
    for r in rows:
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) or not r.base_labels
        assert 0 <= r.score <= 1 and (r.score > 0) == (r.labels != "") and r.labels == ",".join(sorted(set(r.labels.split(","))))
    by_id = {r.doc_id: r.labels for r in rows}
    assert "mit-text" in by_id[6] and by_id[7] == "" and by_id[10] == ""
    assert by_id[8] == "apache,apache-2.0" and by_id[9] == "apache"
    assert by_id[None] == "mit,mit-notice"
    assert licenses.scan(df.limit(0)).count() == 0


def test_all_licences_of_a_file(spark):
    """Several licences in one file, and one licence among other licence words, keep all their labels."""
    text = {label: t for label, t, _ in licenses.TEMPLATES}
    gpl = text["gpl-notice"].replace("free software you", "free software: you")
    header = (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."
    )
    rows = [
        (1, text["mit-text"] + ".\n\n" + text["apache-2.0-text"], {"mit-text", "apache-2.0-text"}),
        (2, text["mit-text"] + ".\n\n" + text["bsd"], {"mit-text", "bsd"}),
        (3, text["mit-text"] + ".\n\n" + gpl + ".\n\n" + text["bsd"], {"mit-text", "gpl-notice", "bsd"}),
        (4, header, {"apache-2.0", "apache-2.0-text"}),
        (5, "\n".join(text[label] for label in text), set(text)),
        (6, ("filler words " * 50 + text["isc"] + "\n" + text["mit-text"] + "\n") * 300, {"isc", "mit-text"}),
    ]
    notices = [(100 + i, "Licensed under the Apache License, Version 2.0.", {"apache-2.0"}) for i in range(20)]
    got = {r.doc_id: set(r.labels.split(",")) for r in licenses.scan(spark.createDataFrame([r[:2] for r in rows + notices], "doc_id long, text string")).collect()}
    for i, _, labels in rows + notices:
        assert labels <= got[i], i


def test_words_put_between_key_phrases(spark):
    """Most words stand at their places to each other, from two beginnings; both key phrases are near theirs."""
    mit = "permission is hereby granted free of charge to any person as well as all companies obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"
    far = mit.replace("as well as all companies", "word " * 30)
    cut = mit.replace("associated documentation", "associated fine documentation")
    rows = [(1, mit), (2, far), (3, cut), (4, "filler " * 500 + mit + " filler")]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: got[i].labels for i in got} == {1: "mit-text", 2: "", 3: "", 4: "mit-text"}
    assert 0.5 <= got[1].score < 1 and got[4].score == got[1].score


def test_labels_and_score_against_plain_loops(spark):
    """The rule written out: rarest words of each template in the file, beginnings they share, weights, key phrases."""
    rng = random.Random(3)
    texts = [t for _, t, _ in licenses.TEMPLATES]
    docs = []
    for i in range(120):
        parts = []
        for _ in range(rng.randrange(4)):
            words = rng.choice(texts).split()
            for _ in range(rng.randrange(6)):
                at = rng.randrange(len(words))
                if rng.random() < 0.5:
                    words.insert(at, rng.choice(["filler", "license", "software", "the"]))
                else:
                    del words[at]
            parts.append(" ".join(words))
            parts.append("filler " * rng.randrange(5))
        docs.append((i, " ".join(parts)))
    words = {i: WORD.findall(t) for i, t in docs}
    content = [[w for w in t.split() if w not in licenses.COMMON] for t in texts]
    every = {w for c in content for w in c}
    seen = {w: sum(w in set(x) for x in words.values()) for w in every}
    idf = {w: math.log((len(docs) + 1) / (n + 1)) + 1e-6 for w, n in seen.items()}
    want = {}
    for i, ws in words.items():
        have, best = set(ws), {}
        for (label, text, keys), mine in zip(licenses.TEMPLATES, content, strict=True):
            tw = text.split()
            if not all(w in have for k in keys for w in k.split()):
                continue
            rare = sorted(set(mine) & have, key=lambda w: (-idf[w], w))[: licenses.RARE]
            begins = {}
            for p, w in enumerate(ws):
                for place, x in enumerate(tw):
                    if x == w and w not in licenses.COMMON:
                        begins.setdefault(p - place, []).append(w)
            for b, found in begins.items():
                share = min(1.0, sum(idf[w] for w in found) / sum(idf[w] for w in mine))
                if len(set(found) & set(rare)) < licenses.AGREE or share < licenses.LEAST_SHARE:
                    continue
                near = True
                for k in keys:
                    k = k.split()
                    place = next(j for j in range(len(tw)) if tw[j : j + len(k)] == k)
                    near &= any(ws[s : s + len(k)] == k and abs(s - place - b) <= licenses.SLACK for s in range(len(ws)))
                if near:
                    best[label] = max(best.get(label, 0), share)
        base = set(plain(" ".join(ws))[4].split(",")) - {""}
        want[i] = (",".join(sorted(base | set(best))), max([0.5 if base else 0.0, *best.values()]))
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert sum(len(x[0]) > 0 for x in want.values()) > 60
    for i, (labels, score) in want.items():
        assert got[i].labels == labels and abs(got[i].score - score) < 1e-9, (i, got[i], want[i])
