"""The operators for training data on small cases: nulls, empties, repeats, clashing names, brute force."""

from __future__ import annotations

import ast
import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestar.llm import code_files, functions, mix, pack, quality, scans, similar, split_items, splits, syntax
from lodestar.schema import LOCATOR

CHUNK = f"id long, revision_id long, ordinal int, kind string, text string, locator {LOCATOR.simpleString()}, piece string, extra int"


def locator(**k):
    return tuple(k.get(n) for n in LOCATOR.fieldNames())


# ------------------------------------------------------------------ 1


def greedy(text, tokens, chars, overlap):
    """One cut after the other, by the same rule."""
    a, b, rank = split_items._tokens(text, chars // 2)
    out, i, n = [], 0, len(a)
    while True:
        high = min(i + tokens - 1, max(j for j in range(n) if b[j] <= a[i] + chars), n - 1)
        stop = high
        if high < n - 1:
            low = min(max(i + overlap, next((j for j in range(n) if b[j] > a[i] + chars // 4), n)), high)
            for want, least in ((1, low), (2, max(low, i + (high - i) // 2))):
                best = [j for j in range(least, high + 1) if rank[j] >= want]
                stop = best[-1] if best else stop
        out.append((int(a[i]), int(b[stop])))
        if stop == n - 1:
            return out
        early = min(max(stop + 1 - overlap, next(j for j in range(n + 1) if j == n or a[j] >= b[stop] - chars // 4), i + 1), stop + 1)
        natural = [j for j in range(early, stop + 1) if j == 0 or rank[j - 1] >= 1]
        i = natural[0] if natural else early


def test_split_by_brute_force():
    rng = random.Random(3)
    texts = ["".join(rng.choice(["word ", "a ", "end. ", "x" * rng.randint(1, 30) + " ", "\n", "\n\n"]) for _ in range(rng.randint(1, 400))) for _ in range(40)] + ["y" * 500, "ü" * 90 + " z"]
    texts = [t for t in texts if t.split()]
    for got, t in zip(split_items.cut(texts, 12, 80, 3), texts):
        assert got == greedy(t, 12, 80, 3)
        pieces = [t[a:b] for a, b in got]
        assert all(len(p) <= 80 and len(p.split()) <= 12 for p in pieces)
        covered = np.zeros(len(t), bool)
        for a, b in got:
            covered[a:b] = True
        assert not any(c not in " \t\n\r" for c, k in zip(t, covered) if not k)


def test_split_chunks(spark):
    long = "\n".join("This is a sentence of some words." for _ in range(60))
    rows = [
        (1, 7, 0, "text", "short", locator(char_start=0, line_start=1), "p", 1),
        (2, 7, 1, "text", long, locator(char_start=100, line_start=5, line_end=64), "p", 1),
        (2, 7, 1, "text", long, locator(char_start=100, line_start=5, line_end=64), "p", 1),
        (3, 7, 2, "text", None, None, None, None),
        (4, 7, 3, "image", "", None, None, None),
        (5, 8, 0, "text", " " * 2500, None, None, None),
    ]
    df = spark.createDataFrame(rows, CHUNK)
    got = split_items.split_chunks(df).orderBy("revision_id", "ordinal").collect()
    own = [r for r in got if r.chunk_id == 2]
    assert len(own) > 1 and [r.ordinal for r in got if r.revision_id == 7] == list(range(len(own) + 3))
    for r in own:
        a = r.locator.char_start - 100
        assert long[a : r.locator.char_end - 100] == r.text and r.locator.line_start == 5 + long[:a].count("\n")
    assert {r.chunk_id for r in got if r.oversized} == {2, 5}
    assert split_items.split_chunks(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        split_items.split_items(df, "id", "text", 10, 100, 10)


# ------------------------------------------------------------------ 2


def test_similar(spark):
    rng = np.random.default_rng(1)
    centre = rng.normal(size=(30, 16))
    x = (centre[rng.integers(0, 30, 1500)] + 0.6 * rng.normal(size=(1500, 16))).astype(np.float32)
    x[100:110] = x[0]
    rows = [(i, "p", v.tolist(), "clash") for i, v in enumerate(x)] + [(i, "p", x[i].tolist(), "clash") for i in range(5)]
    rows += [(9001, "p", None, ""), (9002, "p", [1.0] * 3, ""), (9003, "p", [0.0] * 16, ""), (9004, "p", [float("nan")] * 16, ""), (9005, "alone", [1.0, 2.0], ""), (9006, None, [1.0], ""), (9007, "p", [None] * 16, ""), (9008, "unknown", [1.0], "")]
    df = spark.createDataFrame(rows, "id long, profile_id string, vector array<float>, dimension string")
    prof = spark.createDataFrame([("p", 16, 1), ("alone", 2, 1), ("none", 4, 1), ("p", 16, 1)], "id string, dimension int, vector int")
    near = similar.most_similar(df, prof, per_part=100, cover=0.95).cache()
    assert near.where("id > 9000 or neighbour > 9000 or id = neighbour").count() == 0
    assert near.groupBy("id").count().where("count > 10").count() == 0 and near.select("id").distinct().count() == 1500
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    got = {}
    for r in near.collect():
        got.setdefault(r.id, set()).add(r.neighbour)
        assert abs(s[r.id, r.neighbour] - r.similarity) < 0.01
    hit = sum(sum(s[i, j] >= np.sort(s[i])[-10] - 0.01 for j in got[i]) for i in range(1500))
    assert hit / 15000 > 0.9
    pairs = {tuple(r) for r in similar.similar_pairs(near, df, 0.9999).collect()}
    assert {(0, 100), (0, 105), (0, 109)} <= pairs and all(a < b for a, b in pairs)
    measured = similar.recall(near, df, prof).collect()
    assert [r.profile_id for r in measured] == ["p"] and measured[0].recall > 0.9
    assert similar.most_similar(df.limit(0), prof).count() == 0
    # on several levels, with parts of parts: every vector still is indexed and asked
    deep = similar.most_similar(df, prof, per_part=50, fan=4, cover=0.97).cache()
    assert similar._levels(1500, 50, 4) == 3 and deep.select("id").distinct().count() == 1500 and deep.where("id > 9000 or id = neighbour").count() == 0
    assert deep.groupBy("id", "neighbour").count().where("count > 1").count() == 0
    assert similar.recall(deep, df, prof).first().recall > 0.85
    assert np.array_equal(np.sort(similar.top(s[1:6], 7)), np.sort(np.argsort(-s[1:6], axis=1)[:, :7]))


def test_similar_at_least(spark):
    """What is below a limit leaves where a part is searched; the rest is as a filter of the whole result."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 16)).astype(np.float32)
    x[300:330] = x[:30] + 0.01 * rng.normal(size=(30, 16)).astype(np.float32)
    df = spark.createDataFrame([(i, "p", v.tolist()) for i, v in enumerate(x)], "id long, profile_id string, vector array<float>")
    prof = spark.createDataFrame([("p", 16)], "id string, dimension int")
    kept = lambda d: sorted(tuple(r) for r in d.select("id", "neighbour").collect())
    for parts in (dict(per_part=100), dict(per_part=50, fan=4)):
        near = similar.most_similar(df, prof, **parts)
        few = similar.most_similar(df, prof, **parts, least=0.95)
        assert kept(few) == kept(near.where("similarity >= 0.95")) and few.count() >= 60
    of = lambda least: similar._meet([2], 2, least)((pa.scalar(0),), pa.table({"id": [1, 2, 3, 1, 2, 3], "is_query": [False] * 3 + [True] * 3, "v": [np.array(v, np.float16).tobytes() for v in ((1, 0), (1, 0), (0, 1))] + similar._small(np.array([(1, 0), (1, 0), (0, 1)], np.float32)).to_pylist()}))
    assert of(-2.0)["id"].to_pylist() == [1, 2, 3] and of(0.9)["id"].to_pylist() == [1, 2] and of(1.5).num_rows == 0


# ------------------------------------------------------------------ 3


def page(n, body, head="", foot=""):
    return "\n".join(x for x in (head, body, foot) if x)


def test_scans(spark):
    common = " ".join(["the memory of a priority queue is small and the copy-on-write table holds evidence"] * 3)
    rows = []
    for i in range(6):
        body = f"{common}\nthe {'mem0ry' if i == 2 else 'memory'} of a pri-\nority queue holds copy-\non-write evi{'-' if i < 5 else 'dence'}" if i < 5 else f"dence and more of the memory with utf8 and 4096\n{common}"
        rows.append((i + 1, 1, i, "ocr", page(i, ("dence is here. " if 0 < i < 5 else "") + body, "Memory tables" if i != 3 else "Mem0ry tables", f"- {i + 7} -"), locator(page=i + 1), "p", 1))
    rows += [rows[0], (50, 2, 0, "ocr", None, None, None, None), (51, 2, 1, "ocr", "  \n", None, None, None), (52, None, None, "ocr", "lonely", None, None, None), (53, 1, 9, "text", "mem0ry", None, None, None)]
    df = spark.createDataFrame(rows, CHUNK)
    got = {(r.chunk_id, r.defect) for r in scans.defects(df).collect()}
    assert {i for i, d in got if d == "running_header"} == {1, 2, 3, 4, 5, 6}
    assert {i for i, d in got if d == "page_number"} == {1, 2, 3, 4, 5, 6}
    assert {i for i, d in got if d == "misread"} == {3, 4}
    assert {i for i, d in got if d == "hyphen"} == {1, 2, 3, 4, 5}
    out = scans.paragraphs(df).collect()
    whole = " ".join(r.text for r in sorted((r for r in out if r.revision_id == 1), key=lambda r: r.paragraph))
    assert "mem0ry" not in whole and "Memory tables" not in whole and "- 8 -" not in whole
    assert "priority queue holds copy-on-write evidence is here." in whole and "utf8 and 4096" in whole
    assert scans.defects(df.limit(0)).count() == 0


def test_edges():
    e = scans.edge
    assert e("— 33 —").number == 33 and e("p. 24").alone and e("3 / 22").number == 3 and e("xiv").number == 14 and e("[5]").decorated
    assert e("HASHING NOTES .... 5") == scans.Edge("hashing notes", 5, False, False)
    assert e("12   Hashing notes").number == 12 and e("5.4 The queue").title == "5.4 the queue"
    assert e("the end of a body line.").title is None and e("goes on here").title is None


def test_pages_of_more_than_five_digits(spark):
    body = "the memory of a queue is small\nand the table holds evidence."
    heads = ["Bound archive {}", "{}   Bound archive", "Bound archive .... {}"]
    rows = [(i, 1, i - 1, "ocr", page(i, body, heads[i % 3].format(i)) if i % 2 else page(i, body, "Bound archive", f"[{i}]" if i % 4 else str(i)), locator(page=i), "p", 1) for i in (*range(99_996, 100_004), *range(2_400_001, 2_400_009))]
    got = {(r.chunk_id, r.defect) for r in scans.defects(spark.createDataFrame(rows, CHUNK)).collect()}
    assert got == {(r[0], d) for r in rows for d in ("running_header", "page_number")}


# ------------------------------------------------------------------ 4 and 6


def code(rows, lang="py"):
    return [(i, r, o, "code", t, locator(char_start=a, line_start=b, language=lang), "clash", 0) for i, r, o, t, a, b in rows]


GOOD = {
    "java": "package a.b;\nimport java.util.*;\n@Foo(\"x\")\npublic class A<T> extends B implements C {\n  private int[] x = {1, 2};\n  A() { this.x = null; }\n  @Override\n  public static <K> int f(int a, List<Map<K, T>> b) throws E {\n    for (int i = 0; i < 3; i++) { x[i] += (int) f(a, b); }\n    for (String s : b) if (s == null) continue; else break;\n    switch (a) { case 1: return 2; default: }\n    try { g(y -> y + 1); } catch (E e) { throw new E(\"}\"); } finally { }\n    return a > 0 ? 1 : -1; // {\n  }\n}\n",
    "js": "import x from 'y';\nconst f = (a, b = 1) => {\n  return { k: a, [b]: `t ${a}` };\n};\nasync function g(...r) {\n  for (const i of r) await f(i)\n  if (!r.length) { return } else { r[0]++ }\n  const q = /a\\/[/]b/g.test('x')\n  return r.map(x => x * 2)\n}\nclass K extends L { constructor() { super(); } get v() { return 1; } }\nexport default g;\n",
    "ts": "import { a } from 'b';\ninterface P { k: number; m?(x: string): void }\nexport function f(a: number, b?: string[]): Promise<Map<string, number>> {\n  const x: number = a as any;\n  return x;\n}\ntype T = A | B;\n",
    "c": "#include <x.h>\n#define M(a) ((a) + \\\n 1)\ntypedef struct { int a; } S;\nstatic int *g(const char *p, unsigned n);\nint f(void) {\n  int a[3] = {1, 2, 3}, *p = &a[0];\n  for (int i = 0; i < 3; i++) { p->x = (int) *p; }\n  do { a[0]--; } while (a[0]);\n  if (p) goto end; else return 1;\nend:\n  return '\\'' + sizeof(int);\n}\n",
    "cpp": "#include <vector>\nusing namespace std;\nnamespace a { class B : public C { public: B() : x(1) {} virtual ~B() = default; private: int x; }; }\ntemplate <typename T>\nauto f(std::vector<int> &v, T t = {}) -> int {\n  for (auto &x : v) { x += [&](int a) { return a; }(1); }\n  std::map<int, std::string> m;\n  return static_cast<int>(v.size());\n}\n",
    "go": "package a\n\nimport (\n\t\"fmt\"\n)\n\ntype S struct {\n\tX int\n}\n\nfunc (s *S) F(a int, b ...string) (int, error) {\n\tx := []int{1, 2}\n\tfor i, v := range x {\n\t\tx[i] = v\n\t}\n\tif a > 1 {\n\t\treturn 1, nil\n\t} else if b != nil {\n\t\tfmt.Println(`raw {`)\n\t}\n\treturn 0, nil\n}\n",
    "rust": "use std::io;\n#[derive(Debug)]\npub struct S<'a> { x: &'a str }\nimpl S<'_> {\n    pub fn f(&self, a: i64) -> Option<i64> {\n        let mut v = vec![1, 2];\n        for i in 0..a { v.push(i as u8); }\n        if let Some(x) = v.pop() { return Some(x); }\n        match a { 1 => None, _ => Some('{' as i64) }\n    }\n}\n",
    "sql": "CREATE TABLE t (id INTEGER PRIMARY KEY, n VARCHAR(3) NOT NULL DEFAULT 'x;' -- {\n);\nINSERT INTO t (id, n) VALUES (1, 'it''s'), (2, NULL);\nSELECT a.id, COUNT(*) AS c FROM t a LEFT JOIN u ON a.id = u.id WHERE a.n LIKE '%(%' AND a.id IN (SELECT id FROM v) GROUP BY a.id HAVING COUNT(*) > 1 ORDER BY c DESC LIMIT 3;\nUPDATE t SET n = 'y' WHERE id = 1;\nDELETE FROM t WHERE id BETWEEN 1 AND 2",
    "python": "import os\n\n@deco(1)\nclass A(B):\n    '''doc {'''\n    x: int = 3\n\n    async def f(self, *a, k=1, **kw) -> int:\n        with open(x) as f, g():\n            return [i for i in a if i] or {**kw, 'a': 1}\n        try:\n            x = lambda y, z=2: y if z else -y\n        except (E, F) as e:\n            raise X from e\n        else: pass\n        return a[1:, ::2]\n",
}


@pytest.mark.parametrize("lang", sorted(GOOD))
def test_syntax(lang):
    text = GOOD[lang]
    if lang == "python":
        ast.parse(text)
    whole = syntax.summary(text, lang, True)
    assert syntax.valid(whole, lang), whole
    lines = text.split("\n")
    for k in range(2, len(lines) - 1, 3):
        torn = "\n".join([*lines[:k], "<<<<<<< HEAD", "a b c", "=======", "d", ">>>>>>> x", *lines[k:]])
        assert not syntax.valid(syntax.summary(torn, lang, True), lang)
    for other, wrong in GOOD.items():
        if other != lang and (other, lang) not in {("c", "cpp"), ("js", "ts")}:
            assert not syntax.valid(syntax.summary(wrong, lang, True), lang), other
    assert not syntax.valid(syntax.summary("Some notes on paging, in prose.\nNothing else, really.\n", lang, True), lang)
    # however the file is cut into pieces, the reduction gives the same verdict
    rng = random.Random(lang)
    for damaged in (text, text[: len(text) // 2], text.replace("(", "", 1)):
        want = syntax.valid(syntax.summary(damaged, lang, True), lang)
        for _ in range(12):
            spots = [i for i in range(1, len(damaged)) if damaged[i - 1] not in " \t\n" and damaged[i] in " \t\n"]  # as windows of tokens end
            cuts = sorted(rng.sample(spots, min(len(spots), rng.randint(1, 4))))
            parts = [damaged[a:b] for a, b in zip([0, *cuts], [*cuts, len(damaged)])]
            maps = [syntax.summary(p, lang, not i) for i, p in enumerate(parts)]
            left = maps[0]
            for m in maps[1:]:
                left = syntax.combine(left, m, lang)
            right = maps[-1]
            for m in reversed(maps[:-1]):
                right = syntax.combine(m, right, lang)
            assert syntax.valid(left, lang) == syntax.valid(right, lang) == want


def test_python_as_the_parser():
    rng = random.Random(5)
    source = GOOD["python"]
    for _ in range(150):
        a = rng.randint(0, len(source) - 1)
        text = source[:a] + rng.choice(["", " ", ")", ":", "\n", "x y"]) + source[a + rng.randint(0, 4) :]
        try:
            ast.parse(text)
            want = True
        except SyntaxError:
            want = False
        if want:
            assert syntax.valid(syntax.summary(text, "python", True), "python") == want, text


def test_verdicts(spark):
    files = spark.createDataFrame([(1, 5, ".PY", "code", 11), (2, 5, ".py", "code", 12), (3, 5, ".py", "code", None), (4, 5, ".md", "text", 13), (5, 6, ".js", "code", 14), (6, 6, None, "code", 15), (7, 6, ".go", "code", 16)], "id long, root_id long, extension string, modality string, active_revision_id long")
    half = "def f(a):\n    return (a +"
    rows = code([(1, 11, 0, "def f(a):", 0, 1), (2, 11, 1, "return a", 14, 2), (2, 11, 1, "return a", 14, 2), (3, 12, 0, half, 0, 1), (4, 14, 0, "f(1); /* open", 0, 1), (5, 14, 1, "open ( */ g();", 9, 1), (6, 99, 0, "((", 0, 1)])
    rows += [(9, 16, 0, "code", None, None, None, None)]
    many = [(1000 + i, 12, i + 1, f"b{i} +" if i < 199 else "1)", len(half) + 1, 2) for i in range(200)]
    at, longer = len(half) + 1, []
    for i, r, o, t, _, _ in many:
        longer.append((i, r, o, t, at, 2))
        at += len(t) + 1
    df = spark.createDataFrame(rows + code(longer), CHUNK)
    got = {r.file_id: r.valid for r in code_files.verdicts(files, df).collect()}
    assert got == {1: True, 2: True, 3: True, 5: True, 7: True} or got == {1: True, 2: True, 5: True, 7: True}
    broken = {r.file_id: r.valid for r in code_files.verdicts(files, df.where("id <> 1100")).collect()}
    assert broken[1]
    cut = {r.file_id: r.valid for r in code_files.verdicts(files, df.where("id < 1199")).collect()}
    assert not cut[2]
    rates = {(r.root_id, r.language): r.share for r in code_files.rates(code_files.verdicts(files, df.where("id < 1199"))).collect()}
    assert rates[5, "python"] == 0.5 and rates[6, "js"] == 0.0
    assert code_files.verdicts(files.limit(0), df).count() == 0 and code_files.verdicts(files, df.limit(0)).where("not valid").count() == 0


@pytest.mark.parametrize(
    "lang,text,names",
    [
        ("python", 'def a(x):\n    """Sort all the pages by number."""\n\ndef b():\n    # """No comment is documentation here."""\n    return 1\n\ndef c(\n  x,\n) -> int:\n    r\'\'\'Give the number\n    of open pages.\'\'\'\n# def d():\n#     """Code in comments never counts at all."""\ndef e():\n    """TODO write the documentation of this one later"""\n', {"a", "c"}),
        ("java", "class A {\n  /** Sorts all the pages by number. */\n  @Override\n  public int sort(int a) { return 1; }\n  /** Far away from its own function. */\n\n  int far() { return 2; }\n  /* Not a comment that documents it. */\n  int plain() { return 3; }\n  /** @param a the number of a page */\n  int only(int a) { return 4; }\n}\n", {"sort"}),
        ("js", "/** Sorts all the pages by number. */\nexport const sortAll = async (a, b) => {\n};\n/** Gives the number of open pages. */\nfunction open() {}\n/** Opens all the open opening. */\nfunction openAll() {}\n", {"sortAll", "open"}),
        ("c", "/// Sorts all the pages by number.\n/// And by name.\nstatic int *sort_all(int a) { return 0; }\n// Counts all the pages by number.\nint count(void) { return 0; }\n/** Gives the number of open pages. */\ntemplate <typename T>\nauto A::give(T t) -> int {\n", {"sort_all", "give"}),
        ("go", "package a\n\n// Sort puts all the pages in order.\nfunc (s *S) Sort(a int) int {\n}\n\n// Far away from its own function.\n\nfunc Far() {}\n\n// rows is the number of all pages.\nfunc Only(rows int) {}\n", {"Sort"}),
        ("rust", "/// Sorts all the pages by number.\n#[inline]\npub fn sort_all(a: i64) -> i64 { 0 }\n// Counts all the pages by number.\nfn count() {}\n", {"sort_all"}),
    ],
)
def test_functions(lang, text, names):
    got = {f[0] for f in functions.functions_in(text, lang) if f[4] and functions.says_something(f[4], f[0], f[6])}
    assert got == names
    # a file of another extension is read as what it is written in
    other = "java" if lang != "java" else "python"
    assert {f[0] for f in functions.functions_in(text, other) if f[4] and functions.says_something(f[4], f[0], f[6])} == names


def test_pairs(spark):
    head = "#include <a.h>\n/** Sorts all the pages by number. */\nint sort_all(int a, char *b);\n"
    rows = code([(1, 1, 0, head, 0, 1), (2, 2, 0, "#include <a.h>\nint sort_all(int x, char *y)\n{\n  return 1;\n}\nint sort_all(double x)\n{ return 2; }\n", 0, 1)], "c")
    doc = '"""Gives the number of'
    rows += code([(3, 3, 0, f"def open_pages():\n    {doc}", 0, 1), (4, 3, 1, 'open pages."""\n    return 1', len(doc) + 23, 2), (4, 3, 1, 'open pages."""\n    return 1', len(doc) + 23, 2)])
    rows += [(5, 4, 0, "code", None, None, None, None), (6, 4, 1, "code", "", None, None, None)]
    df = spark.createDataFrame(rows, CHUNK)
    roots = spark.createDataFrame([(1, 9, 0), (2, 9, 0), (2, 9, 0)], "revision_id long, root_id long, doc int")
    table = functions.symbols(df)
    # without roots a declaration stands for itself; in both cases the documentation counts where it stands
    assert {(r.revision_id, r.func_name) for r in functions.pairs(table).collect()} == {(3, "open_pages"), (1, "sort_all")}
    for some in (None, roots):
        assert {tuple(r) for r in functions.documented(functions.pairs(table, some)).collect()} == {(3, "open_pages"), (1, "sort_all")}
    lent = functions.pairs(table, roots).where("not own").collect()
    assert [(r.revision_id, r.signature) for r in lent] == [(2, "int,char*")] and "return 1" in lent[0].code
    assert functions.pairs(functions.symbols(df.limit(0)), roots).count() == 0


def test_scopes():
    """Methods of one name and signature in several classes are several functions, qualified by what encloses them."""
    doc = "Sorts all the pages by number."
    texts = {
        "python": f'class A:\n    def run(self, x):\n        """{doc}"""\n        def inner(y):\n            return y\n\nclass B:\n    class C:\n        def run(self, x):\n            """{doc}"""\n\ndef run(self, x):\n    """{doc}"""\n',
        "java": f"class A {{\n  /** {doc} */\n  int run(int x) {{ return 1; }}\n}}\nclass B {{\n  static class C {{\n    /** {doc} */\n    int run(int y) {{ return 1; }}\n  }}\n}}\n",
        "cpp": f"namespace A {{\n/** {doc} */\nint run(int x) {{ return 1; }}\n}}\n/** {doc} */\nint B::C::run(int x) {{ return 2; }}\n",
        "rust": f"impl A {{\n    /// {doc}\n    fn run(x: i64) {{}}\n}}\nimpl T for B {{\n    /// {doc}\n    fn run(x: i64) {{}}\n}}\n",
    }
    got = {lang: [f[1] for f in functions.functions_in(t, lang) if f[4]] for lang, t in texts.items()}
    assert got == {"python": ["A.run", "B.C.run", "run"], "java": ["A.run", "B.C.run"], "cpp": ["A.run", "B.C.run"], "rust": ["A.run", "B.run"]}
    twice = f'class A:\n    @property\n    def x(self):\n        """{doc}"""\n\n    @x.setter\n    def x(self):\n        """{doc}"""\n'
    assert len(functions.functions_in(twice, "python")) == 2


def test_functions_over_borders(spark):
    """Files cut in chunks anywhere and read in small blocks give the functions of the whole file."""
    texts = {
        "py": "import os\n\n" + "".join(f'class K{i}:\n    def f{i}(self, a):\n        """Gives the number {i} of open pages.\n\n        More on it.\n        """\n        x = "{{"\n        return a\n\n\n' for i in range(30)),
        "java": "package a;\n\nclass A {\n" + "".join(f"  /** Gives the number {i} of open pages.\n\n   * More (of it. */\n  @Override\n  int f{i}(int a) {{\n    if (a > 1) {{ return 2; }}\n    return 1; // {{\n  }}\n\n" for i in range(30)) + "}\n",
        "go": "package a\n\n" + "".join(f"// F{i} gives the number of open pages\n// and more.\nfunc F{i}(a int) int {{\n\treturn {i}\n}}\n\n" for i in range(30)),
    }
    rows, want = [], {}
    for r, (lang, text) in enumerate(texts.items()):
        at, o = 0, 0
        rng = random.Random(r)
        words = [m.span() for m in __import__("re").finditer(r"\S+", text)]
        while at < len(words):
            n = rng.randint(1, 9)
            a, b = words[at][0], words[min(at + n, len(words)) - 1][1]
            rows.append((len(rows), r, o, text[a:b], a, text.count("\n", 0, a) + 1, lang))
            at, o = at + n, o + 1
        want[r] = sorted((f[0], f[2], f[4], f[5].split()) for f in functions.functions_in(text.rstrip(), functions.syntax.LANGUAGES[lang]))
    df = spark.createDataFrame([(i, r, o, "code", t, locator(char_start=a, line_start=b, language=lang), "clash", 0) for i, r, o, t, a, b, lang in rows], CHUNK)
    for per_block in (4, 16, 256):
        got: dict = {}
        for x in functions.symbols(df, per_block).collect():
            got.setdefault(x.revision_id, []).append((x.name, x.signature, x.doc, x.code.split()))  # tabs between chunks come back as blanks
        assert {r: sorted(v) for r, v in got.items()} == want, per_block


# ------------------------------------------------------------------ 5


def test_splits(spark):
    rng = random.Random(2)
    q, j = [], []
    for i in range(300):
        fam = rng.choice([None, "", "!!", *(f"Fäm {k}" for k in range(150))])
        q.append((f"q{i}", fam if not fam or i % 2 else fam.upper().replace("Ä", "A").replace(" ", "-"), rng.choice([None, " ", "Train", "test ", "validation"]), "x"))
    q += [(f"hot{i}", "the hot family", "train", "x") for i in range(150)] + [q[0], (None, "a", "train", "x")]
    j = [(f"q{rng.randrange(300)}", rng.choice(["", "./", ".\\"]) + f"d/{rng.randrange(200)}.md", 1, None) for _ in range(150)] + [("nobody", "d/1.md", 1, None), ("q1", None, 1, None)]
    j += [(f"q{i}", f"chain/{i}", 1, None) for i in range(200, 240)] + [(f"q{i}", f"chain/{i + 1}", 1, None) for i in range(200, 240)]
    qs = spark.createDataFrame(q, "id string, family string, split string, component string")
    js = spark.createDataFrame(j, "query_id string, path string, grade int, node string")
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    import unicodedata

    def key(n):
        return "".join(c for c in unicodedata.normalize("NFD", (n or "").casefold()) if c.isalnum())

    ids = {r[0] for r in q if r[0]}
    for i, fam, *_ in q:
        if i:
            find(i)
            if key(fam):
                up[find(i)] = find("f:" + key(fam))
    for i, path, *_ in j:
        if i in ids and path:
            p = path.replace("\\", "/")
            up[find(i)] = find("p:" + (p[2:] if p.startswith("./") else p))
    rel = splits.related(qs, js).cache()
    got = {r.query_id: r.component for r in rel.collect()}
    assert set(got) == ids
    groups, mine = {}, {}
    for i in ids:
        groups.setdefault(find(i), set()).add(i)
        mine.setdefault(got[i], set()).add(i)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))
    want = set()
    state = {i: s.strip().lower() for i, _, s, _ in q if i and s and s.strip()}
    for g in groups.values():
        if len({state[i] for i in g if i in state}) > 1:
            want |= {i for i in g if i in state}
    assert {r.query_id for r in splits.breaches(rel).collect()} == want
    dealt = splits.assign(rel).collect()
    assert {r.query_id for r in dealt} == ids and len({(r.component, r.split) for r in dealt}) == len(mine)
    assert splits.breaches(splits.related(qs.limit(0), js)).count() == 0 and splits.assign(splits.related(qs.limit(0), js.limit(0))).count() == 0


# ------------------------------------------------------------------ 7, 8


def test_pack(spark):
    rng = np.random.default_rng(4)
    sizes = rng.integers(1, 100, 3000)
    place = pack.sum_of_squares(np.sort(sizes)[::-1], 100)
    fill = np.bincount(place, weights=np.sort(sizes)[::-1])
    assert fill.max() <= 100 and len(fill) <= 1.06 * np.ceil(sizes.sum() / 100)
    rows = [(i, "word " * int(n), "x") for i, n in enumerate(rng.integers(0, 60, 400))] + [(1000, "word " * 950, "x"), (1001, None, "x"), (1002, "  ", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, piece string")
    got = pack.pack_documents(df, capacity=128, per_group=40).collect()
    by, docs = {}, {}
    for r in got:
        by.setdefault(r.container, []).append(r)
        docs.setdefault(r.doc_id, []).append(r)
    assert all(sum(r.tokens for r in v) == v[0].fill <= 128 for v in by.values())
    assert {d for d, v in docs.items() if len(v) > 1} == {1000} == {r.doc_id for r in got if r.oversized}
    assert sum(r.tokens for r in got) <= 128 * len(by) <= 1.1 * sum(r.tokens for r in got) + 128 and 1001 not in docs
    assert pack.pack_documents(df.limit(0)).count() == 0
    assert pack.containers(pack.pack_documents(df, capacity=128), 128).where("tokens + unused <> 128").count() == 0


def test_mix(spark):
    rng = random.Random(6)
    rows = [(i, "word " * rng.randint(5, 60), rng.choice(["en", "de", None, "??"]), [" BIG source", "mid-one", "small"][min(2, int(rng.expovariate(1)))], rng.choice(["text", None, "odd"]), 1) for i in range(1500)]
    rows += [(9000, None, "en", "small", "text", 1), (9001, "word " * 50, "en", None, "text", 1), (9002, "word " * 50, "en", "unnamed", "text", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, modality string, copies int")
    targets = spark.createDataFrame([("big_source", 0.3, 2), ("mid_one", 0.4, 3), ("small", 0.29, 1), ("absent", 0.01, 4), ("absent", 0.01, 4)], "source string, target_share double, max_repeats int")
    drawn, report = mix.mixture(df, targets)
    got = {r.source: r for r in report.collect()}
    assert {s for s, r in got.items() if not r.reachable} == {"small", "absent"}
    cap = {"big_source": 2, "mid_one": 3, "small": 1}
    assert all(r.copies <= cap[r.source] for r in drawn.collect())
    total, mixed = sum(len(r[1].split()) for r in rows if r[1]), sum(r.mixed_tokens for r in got.values())
    assert mixed > 0
    assert got["small"].mixed_tokens == got["small"].tokens and abs(got["big_source"].actual_share / got["mid_one"].actual_share - 0.75) < 0.05 and total
    assert abs(sum(r.actual_share for r in got.values()) - 1) < 1e-9
    empty = mix.mixture(df.limit(0), targets)
    assert empty[0].count() == 0 and all(not r.mixed_tokens for r in empty[1].collect())
    cells = pd.DataFrame({"source": ["a", "a", "b"], "lang": ["x", "y", "x"], "topic": ["t"] * 3, "tokens": [100, 50, 50], "share": [0.5, 0.5, 0.5], "cap": [4, 4, 4]})
    w = mix.rake(cells, 200.0)
    assert abs((w.tokens * w.weight)[:2].sum() - 100) < 1e-6 and abs((w.tokens * w.weight)[2] - 100) < 1e-6


# ------------------------------------------------------------------ 9


def test_quality(spark):
    prose = "The page table of a small system is in the memory. It was read by the counter, and that is all that there was to it. " * 1
    wrapped = "the page table of a small\nsystem is in the memory and it\nwas read by the counter that is\nall there was to it and so on\nas it was"
    items = "\n".join(f"- {w} page" for w in "small large open closed first last".split())
    plain = "small page\nan open table\nthe counter\nlarge memory of all\nfirst\nthe last of pages\nnew counter"
    table = "\n".join(f"a{i}\t{i}\tx" for i in range(8))
    rows = [(1, prose, "en"), (2, wrapped, None), (3, items, "en"), (4, plain, "EN "), (5, table, "de"), (6, "page cache index " * 30, "en"), (7, "#@{}%$&*" * 20, None), (8, None, "en"), (9, " \n ", "en"), (10, prose + "\n\n- one page\n- two pages", "xx"), (11, prose, "en"), (12, "\n".join("- " + s.strip() + "." for s in prose.split(".") if s.strip()), "en"), (13, "Yes.", "en")]
    rows += [(100 + i, prose + " " + "It was read by the counter. " * (i % 3), "en") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("words", F.lit("clash"))
    words = spark.createDataFrame([("en", w) for w in "the of a is in it was by and that all there to so on as".split()] + [("de", "und"), (None, "x"), ("en", None)], "lang string, word string")
    got = {r.doc_id: r for r in quality.assess(df, words).collect()}
    # entries are a list whatever they say (12); a phrase without end, and signs, are junk; blank texts have no form
    assert {i: got[i].form for i in range(1, 14)} == {1: "prose", 2: "prose", 3: "list", 4: "list", 5: "table", 6: "junk", 7: "junk", 8: None, 9: None, 10: "prose", 11: "prose", 12: "list", 13: "prose"}
    assert got[1].words == len(quality.WORD.findall(prose)) and got[8].words == 0
    assert not got[100].flagged and got[3].flagged and got[3].z_marked_lines == float("inf")
    assert quality.assess(df.limit(0), words).count() == 0
    commons = quality.word_lists(words)
    assert quality.statistics(df, {}).where("language <> 'und'").count() == 0 and commons["de"] == {"und"}


def test_quality_by_the_sketches(spark):
    """The same block is junk or prose by the distribution of its language: the sketches decide, not a fixed share."""
    block = ["page cache index of memory table entry vector segment the hash bucket slot frame journal parser"] * 1
    common = frozenset(["the", "of", "a", "is", "and", "to"])
    usual = lambda median, spread: {"common_words": (median, spread), "letter_ratio": (0.97, 0.01)}
    long = [" ".join(w + c for w in block[0].split() for c in "xyz")] 
    assert quality._plain_block(long, common, usual(0.4, 0.02)) == "junk" and quality._plain_block(long, common, usual(0.05, 0.02)) == "prose"
    assert quality._plain_block(long, common, {"common_words": None, "letter_ratio": None}) == "prose"
    assert quality._off(0.2, 10, (0.4, 0.02)) == 0.0 and quality._off(0.2, 1000, (0.4, 0.02)) < -3.5 and quality._off(0.2, 100, (0.4, 0.0)) == -float("inf")
