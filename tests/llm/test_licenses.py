import math
import re
from collections import Counter

from pyspark.sql import functions as F

from determina.llm import licenses


def bag(text):
    return Counter(re.findall(r"[0-9a-z]+", text.lower()))


def test_cosine_against_plain_sums(spark):
    lines = ["Released under the MIT License.", "Licensed under CC BY-NC 4.0 by us", "the the cat", "the law of the license is mit", "", "MIT"]
    texts = ["\n".join(lines[:2]), lines[2], "\n\n" + lines[3] + "\n", None, "", "\n".join(lines), lines[0] + "\n" + lines[0]]
    known = {w for _, t in licenses.TEMPLATES for w in bag(t)}
    df = Counter(w for t in texts for w in set(bag(t or "")) if w in known)
    idf = lambda w: math.log((len(texts) + 2) / (df[w] + 1)) if w in known else math.log(len(texts) + 2)

    def best(line):
        a, out = bag(line), (0.0, None)
        norm = math.sqrt(sum((n * idf(w)) ** 2 for w, n in a.items()))
        for name, t in licenses.TEMPLATES:
            b = bag(t)
            dot = sum(a[w] * b[w] * idf(w) ** 2 for w in a)
            value = dot / norm / math.sqrt(sum((n * idf(w)) ** 2 for w, n in b.items())) if norm else 0
            out = max(out, (value, name), key=lambda x: x[0])
        return out

    got = {r.row.i: r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), least=0.5).collect()}
    for i, t in enumerate(texts):
        want = [x for x in map(best, (t or "").split("\n")) if x[0] >= 0.5]
        assert got[i].found == sorted({n for _, n in want})
        assert math.isclose(got[i].score, max((min(v, 1.0) for v, _ in want), default=0.0), abs_tol=1e-9)
    assert got[6].n_license_words == 10


def test_inheritance(spark):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    rows = [("a/LICENSE", mit), ("a/x.py", "code"), ("a/b/y.py", "code"), ("a/b/c/COPYING.txt", gpl), ("a/b/c/d/z.py", "code"), ("ab/q.py", "code"), ("a/b/own.py", gpl + "\n" + "code " * 30), (None, "code"), ("top.py", "code"), ("/abs/f", "code"), ("a/b/c/LICENSE", "words only")]
    scanned = licenses.scan(spark.createDataFrame([(*r, "x") for r in rows], "file string, text string, license string"))
    got = {r.row.file: (r.effective, r.origin, r.from_dir) for r in licenses.inherit(scanned, F.col("row.file")).collect()}
    assert got == {
        "a/LICENSE": ("MIT", "own", None), "a/x.py": ("MIT", "inherited", "a"), "a/b/y.py": ("MIT", "inherited", "a"), "a/b/c/COPYING.txt": ("GPL-3.0", "own", None), "a/b/c/d/z.py": ("GPL-3.0", "inherited", "a/b/c"),
        "ab/q.py": (None, "none", None), "a/b/own.py": ("GPL-3.0", "own", None), None: (None, "none", None), "top.py": (None, "none", None), "/abs/f": (None, "none", None), "a/b/c/LICENSE": ("GPL-3.0", "inherited", "a/b/c")}


def test_empty_and_long(spark):
    assert licenses.scan(spark.createDataFrame([], "text string")).collect() == []
    (r,) = licenses.scan(spark.createDataFrame([("word " * 200_000 + "\nMIT\n" + "Released under the MIT License.",)], "text string")).collect()
    assert r.license == "MIT" and r.n_words == 200_006


def test_wrapped_headers_whole_files_and_reworded(spark):
    whole = {n: max((t for k, t in licenses.TEMPLATES if k == n), key=len) for n in ("Apache-2.0", "BSD-3-Clause", "GPL-3.0", "MIT", "MPL-2.0")}
    header = next(t for n, t in licenses.TEMPLATES if n == "GPL-3.0" and t.startswith("This program")).split()
    wrapped = "/*\n" + "\n".join(" * " + " ".join(header[i : i + 7]) for i in range(0, len(header), 7)) + "\n */\n" + "int main void code\n" * 50
    rows = [(n, "\n".join(t.split())) for n, t in whole.items()] + [
        ("GPL-3.0", wrapped), ("MIT", "This project is released under the MIT License."), ("MIT", "Copyright (c) 2020 Jane Doe. Released under the MIT License."),
        ("MIT", "The MIT License (MIT)"), ("MIT", "MIT License\n\nCopyright (c) 2020 Jane Doe\n\n" + whole["MIT"]), (None, "plain prose about a cat " * 40)]
    got = {r.row.i: r for r in licenses.scan(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, want string, text string")).collect()}
    assert [got[i].license for i in range(len(rows))] == [n for n, _ in rows]
    assert got[5].n_license_words < got[5].n_words / 2
