"""Problem 4: functions paired with their documentation.

Method: a symbol table of all functions of all files, by qualified name and normalised signature; documented declarations are
joined with separate definitions of the same symbol, then pairs whose documentation says nothing are left out.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm import syntax
from lodestar.llm.code_files import blocks

_MODS = r"(?:(?:public|private|protected|static|final|abstract|synchronized|native|default|strictfp)\s+)*"
#: How a function begins, by family of languages; group ``n`` is its name. Comments and strings are blanked before.
HEADS = {
    "python": re.compile(r"^[ \t]*(?:async[ \t]+)?def[ \t]+(?P<n>\w+)[ \t]*(?:\[[^\]\n]*\])?[ \t]*(?P<p>\()", re.M),
    "go": re.compile(r"^func[ \t]*(?:(?P<q>\([^()\n]*\))[ \t]*)?(?P<n>\w+)[ \t]*(?:\[[^\]\n]*\])?[ \t]*(?P<p>\()", re.M),
    "rust": re.compile(r"^[ \t]*(?:pub(?:\([^()\n]*\))?[ \t]+)?(?:(?:const|async|unsafe|default|extern(?:[ \t]+\S+)?)[ \t]+)*fn[ \t]+(?P<n>\w+)[ \t]*(?:<[^()\n]*>)?[ \t]*(?P<p>\()", re.M),
    "js": re.compile(
        r"^[ \t]*(?:(?:(?:export[ \t]+)?(?:default[ \t]+)?(?:declare[ \t]+)?(?:async[ \t]+)?function[ \t]*\*?[ \t]*(?P<n>[\w$]+)[ \t]*(?:<[^()\n]*>)?[ \t]*(?P<p>\())"
        r"|(?:(?:export[ \t]+)?(?:const|let|var)[ \t]+(?P<a>[\w$]+)[ \t]*(?::[^=\n]+(?:=>[^=\n]+)?)?=[ \t]*(?P<arrow>(?:async\b[ \t]*)?(?:(?:<[^()\n]*>)?[ \t]*\(|function\b[^(\n]*\(|[\w$]+[ \t]*=>)))"
        r"|(?:(?:(?:public|private|protected|static|async|readonly|override|get|set)[ \t]+)*\*?(?P<m>[\w$]+)[ \t]*(?:<[^()\n]*>)?(?P<mp>\()))",
        re.M,
    ),
    "java": re.compile(rf"^[ \t]*(?:@\w+(?:\([^()\n]*\))?[ \t]+)*(?P<d>{_MODS})(?:<[^()\n]*>[ \t]*)?(?:(?P<t>[\w.]+(?:<[^()\n=;]*>)?(?:\[\])*)[ \t]+)?(?P<n>\w+)[ \t]*(?P<p>\()", re.M),
    "c": re.compile(r"^[ \t]*(?:template[ \t]*<[^\n{};]*>[ \t\n]*)?(?P<t>(?:[\w:]+(?:<[^\n(){};]*>)?(?:::\w+)*[ \t*&]+)+)(?P<n>(?:\w+::)*~?\w+)[ \t]*(?P<p>\()", re.M),
}
LEXED = {"python": "python", "go": "go", "rust": "rust", "js": "js", "ts": "ts", "java": "java", "c": "cpp", "cpp": "cpp", "sql": "sql"}
FAMILY = {"python": "python", "go": "go", "rust": "rust", "js": "js", "ts": "js", "java": "java", "c": "c", "cpp": "c"}
#: Words that stand before brackets without being a function's name (fixed values of the languages).
NOT_NAMES = frozenset("if for while switch return else catch new throw sizeof do case delete typeof await yield assert function super this synchronized try goto in of elif not and or alignof decltype static_assert defined let const var import constructor".split())
#: Comments that document, by family.
_STAR = re.compile(r"/\*\*(?![*/])[\s\S]*?\*/|/\*\*/")
MARK = re.compile(r"^(?:<{7}|={7}|>{7}|\|{7})(?:[ \t].*)?\n?", re.M)
CONFLICT = re.compile(r"^<{7}(?:[ \t].*)?\n(?:(?!<{7}|>{7}).*\n)*?={7}[ \t]*\n(?:(?!<{7}|>{7}).*\n)*?>{7}(?:[ \t].*)?(?:\n|$)", re.M)
_DOCSTRING = re.compile(r"""[ \t]*[rRuU]?(?:(?P<t>\"\"\"|''')(?P<x>(?:\\[\s\S]|(?!(?P=t))[\s\S])*)(?P=t)|(?P<q>["'])(?P<y>(?:\\[\s\S]|(?!(?P=q))[^\n\\])*)(?P=q))""")
WORD = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")
ARTICLES = frozenset("the a an this that its of to for and or on in with by from der die das ein eine el la los las un una le les l des du de et und y".split())


def blanked(text: str, language: str) -> tuple[str, list[tuple[int, int]]]:
    """The text with comments and strings blanked out, offsets kept, and the spans of the comments."""
    out, comments, last = [], [], 0
    for m in syntax.lexer(language).finditer(text):
        kind = m.lastgroup
        if kind in ("line", "block"):
            comments.append(m.span())
        elif kind in ("open", "bopen", "topen", "kopen") and kind != "open":
            comments.append((m.start(), len(text))) if kind == "bopen" else None
            out.append(text[last : m.start()])
            out.append("".join(c if c == "\n" else " " for c in text[m.start() :]))
            last = len(text)
            break
        elif kind == "open" and len(m[0].lstrip("rRbBuUfF")) == 3:
            out.append(text[last : m.start()])
            out.append("".join(c if c == "\n" else " " for c in text[m.start() :]))
            last = len(text)
            break
        elif kind not in ("str", "text", "tick", "raw", "h", "regex", "pre"):
            continue
        out.append(text[last : m.start()])
        out.append("".join(c if c == "\n" else " " for c in m[0]) if kind != "str" or language != "python" else "".join(c if c == "\n" else '"' for c in m[0]))
        last = m.end()
    out.append(text[last:])
    return "".join(out), comments


def _close(text: str, at: int) -> int:
    """The place behind the bracket that closes the one at ``at``, or -1."""
    depth = 0
    for m in re.compile(r"[()\[\]{}]").finditer(text, at):
        depth += 1 if m[0] in "([{" else -1
        if not depth:
            return m.end()
    return -1


def family_of(text: str, declared: str | None) -> tuple[str, str] | None:
    """``(family, language)`` that a text is written in: the one with most beginnings of functions, the declared one first."""
    best = None
    if re.search(r"^\s*(?:package\s+\w+\s*$|func\s)", text, re.M) and re.search(r"^func\b", text, re.M):
        signs = {"go": 9}
    else:
        signs = {}
    for family, language in (("python", "python"), ("go", "go"), ("rust", "rust"), ("js", "js"), ("java", "java"), ("c", "cpp")):
        own = FAMILY.get(declared or "") == family
        n = signs.get(family, 0)
        if family == "python":
            n += len(re.findall(r"^[ \t]*(?:async[ \t]+)?def[ \t]+\w+[ \t]*\(", text, re.M)) * 2
        elif family == "go":
            n += len(re.findall(r"^func[ \t(]", text, re.M)) * 2
        elif family == "rust":
            n += len(re.findall(r"^[ \t]*(?:pub(?:\(\w+\))?[ \t]+)?(?:async[ \t]+|unsafe[ \t]+|const[ \t]+)*fn[ \t]+\w+", text, re.M)) * 2
        elif family == "js":
            n += len(re.findall(r"^[ \t]*(?:export[ \t]+)?(?:default[ \t]+)?(?:async[ \t]+)?function\b|=>[ \t]*\{?[ \t]*$|^import[ \t].*\bfrom\b", text, re.M)) * 2
        elif family == "java":
            n += len(re.findall(r"^[ \t]*(?:(?:public|private|protected|static|final)[ \t]+)+[\w<>\[\], ]+?\w+[ \t]*\(|^(?:package|import)[ \t]+[\w.*]+;|^[ \t]*(?:public[ \t]+)?(?:final[ \t]+)?(?:class|interface)[ \t]+\w+", text, re.M)) * 2
        else:
            n += len(re.findall(r"^[ \t]*#[ \t]*(?:include|define|ifdef|ifndef|pragma)\b|^(?:(?:static|inline|const|unsigned|extern|template)\b.*|[\w:<>]+[ \t*&]+\w+[ \t]*\([^;\n]*\)[^;\n]*\{?[ \t]*$|auto[ \t]+\w+\()", text, re.M)) * 2 - 2 * len(re.findall(r"^[ \t]*(?:def|func|fn)[ \t]", text, re.M))
        n += own
        if n > (best[0] if best else 0):
            best = (n, family, declared if own else language)
    return best and (best[1], best[2])


def _clean(comment: str) -> list[str]:
    """The lines of a comment without what makes it one."""
    if comment.startswith("/*"):
        comment = re.sub(r"^/\*+|\*+/$", "", comment)
        return [re.sub(r"^[ \t]*\*+[ \t]?", "", x).strip() for x in comment.split("\n")]
    return [re.sub(r"^[ \t]*//[/!]?[ \t]?", "", x).strip() for x in comment.split("\n")]


def _above(text: str, lines: list[int], line: int, family: str, comments: dict[int, tuple[int, int]], code: list[str]) -> list[str] | None:
    """The documentation directly above ``line``: annotations, attributes and decorators may stand between."""
    k = line - 1
    while k >= 0 and code[k].strip() and re.match(r"[ \t]*(?:@\w|#!?\[|\[\[|template[ \t]*<)", code[k]):
        k -= 1
    while k >= 0 and code[k].strip() == ")" and family in ("java", "js"):  # an annotation over several lines
        j = k
        while j >= 0 and not re.match(r"[ \t]*@\w", code[j]) and code[j].strip():
            j -= 1
        if j < 0 or not re.match(r"[ \t]*@\w", code[j]):
            break
        k = j - 1
    if k < 0 or code[k].strip():
        return None
    raw = text[lines[k] : lines[k + 1] if k + 1 < len(lines) else len(text)].rstrip("\n")
    if not raw.strip() or k not in comments:
        return None
    a, b = comments[k]
    comment = text[a:b]
    if comment.startswith("/*"):
        if family in ("go", "rust") or not _STAR.fullmatch(comment) or text[b : b + len(raw)].split("\n")[0].strip():
            return None
        before = text[text.rfind("\n", 0, a) + 1 : a]
        return None if before.strip() else _clean(comment)
    wanted = {"go": r"[ \t]*//", "rust": r"[ \t]*///(?!/)", "c": r"[ \t]*///(?!/)"}.get(family)
    if wanted is None:
        return None
    got: list[str] = []
    while k >= 0 and k in comments and not code[k].strip():
        own = text[lines[k] : lines[k + 1] if k + 1 < len(lines) else len(text)].rstrip("\n")
        if not re.match(wanted, own):
            break
        got.append(own)
        k -= 1
    return _clean("\n".join(reversed(got))) if got else None


#: What encloses functions, by family; group ``n`` is its name (of a Rust implementation the type).
SCOPES = {
    "python": re.compile(r"^(?P<i>[ \t]*)(?:class[ \t]+(?P<n>\w+)|(?:async[ \t]+)?def[ \t]+(?P<f>\w+))", re.M),
    "java": re.compile(r"\b(?:class|interface|enum|record)\s+(?P<n>\w+)[^;{}()]*(?:\([^()]*\)[^;{}()]*)?(?P<b>\{)"),
    "js": re.compile(r"\b(?:class|namespace|interface)\s+(?P<n>[\w$]+)[^;{}()]*(?P<b>\{)"),
    "c": re.compile(r"\b(?:class|struct|namespace|union)\s+(?:\[\[[^\]]*\]\]\s*)?(?P<n>\w+)(?:\s+final)?\s*(?::[^;{}()]*)?(?P<b>\{)"),
    "rust": re.compile(r"\b(?:impl\b\s*(?:<[^{};]*?>\s*)?(?:[^{};]*?\bfor\s+)?&?(?P<n>\w+)|(?:trait|mod)\s+(?P<m>\w+))[^{};]*(?P<b>\{)"),
}


def scopes(bare: str, family: str) -> list[tuple[int, int, str]]:
    """``(start, stop, name)`` of what may enclose functions of a text whose comments and strings are blanked."""
    pattern = SCOPES.get(family)
    if pattern is None:
        return []
    out: list[tuple[int, int, str]] = []
    if family == "python":
        open_: list[tuple[int, int, str]] = []
        heads = [(m.start(), len(m["i"].expandtabs()), m["n"] or m["f"]) for m in pattern.finditer(bare)]
        # a scope ends at the next line of its indentation or less; heads alone show it for what they enclose
        for start, indent, name in [*heads, (len(bare), -1, "")]:
            while open_ and open_[-1][1] >= indent:
                a, _, n = open_.pop()
                out.append((a, start, n))
            open_.append((start, indent, name))
        return out
    for m in pattern.finditer(bare):
        stop = _close(bare, m.start("b"))
        out.append((m.start("b"), stop if stop > 0 else len(bare), m["n"] or m.groupdict().get("m") or ""))
    return out


def functions_in(text: str, declared: str | None) -> list[tuple[str, str, str, str, str | None, str]]:
    """``(name, qualified name, signature, kind, documentation, code)`` of the functions of a text; kind is definition or declaration."""
    variants = [text]
    if MARK.search(text):
        variants = [MARK.sub("", CONFLICT.sub("", text)), MARK.sub("", text)]
    seen: dict[tuple, tuple] = {}
    for v in variants:
        times: Counter = Counter()
        for f in _functions_in(v, declared):
            # functions of one symbol are told apart by their order, so that both sides of a conflict meet and none is lost
            key = (*f[1:4], times[f[1:4]])
            times[f[1:4]] += 1
            if key not in seen or (seen[key][4] is None and f[4] is not None):
                seen[key] = f[:7]
    return list(seen.values())


def decided(text: str, declared: str | None) -> tuple[list[tuple], int]:
    """``(functions, hold)`` of a text that goes on: the functions that begin before ``hold``, from where it must be read again.

    The text is held from the last function's comment on if the function has not ended, else from its end, or from the last
    comment behind it. Before that place nothing is open but what encloses functions.
    """
    found = family_of(text, declared)
    bare, spans = blanked(text, found[1] if found else LEXED.get(declared or "", "java"))
    rows = _functions_in(text, declared)
    hold = 0
    if rows:
        last = max(rows, key=lambda f: f[7])
        hold = last[8] if last[8] < len(text.rstrip()) else _comment_above(text, spans, last[7])
    tail = [a for a, b in spans if a >= hold and not text[b:].strip()]
    if not rows or hold == last[8]:
        hold = _comment_above(text, spans, min(tail)) if tail else (hold if bare[hold:].strip() else len(text.rstrip()))
    return [f[:7] for f in rows if f[7] < hold], hold


def _comment_above(text: str, spans: list[tuple[int, int]], at: int) -> int:
    """Where the lines that stand directly above ``at`` begin; a comment counts whole."""
    at = text.rfind("\n", 0, at) + 1
    while at > 0:
        above = text.rfind("\n", 0, at - 1) + 1
        if not text[above : at - 1].strip():
            break
        around = [a for a, b in spans if a < at - 1 and b > above]
        at = text.rfind("\n", 0, min(around)) + 1 if around and min(around) < above else above
    return at


def _functions_in(text: str, declared: str | None) -> list[tuple]:
    """As ``functions_in``, of one text; the last two are the names of the parameters and where the function begins."""
    found = family_of(text, declared)
    if not found:
        return []
    family, language = found
    bare, spans = blanked(text, language)
    lines = [0]
    for m in re.finditer("\n", text):
        lines.append(m.end())
    code = bare.split("\n")
    comments: dict[int, tuple[int, int]] = {}
    line_of = _Lines(lines)
    for a, b in spans:
        for k in range(line_of(a), line_of(max(a, b - 1)) + 1):
            comments.setdefault(k, (a, b))
    out = []
    around = sorted(scopes(bare, family))
    inside: list[tuple[int, int, str]] = []
    nth = 0
    for m in HEADS[family].finditer(bare):
        while nth < len(around) and around[nth][0] < m.start():
            inside.append(around[nth])
            nth += 1
        inside = [x for x in inside if x[1] > m.start()]
        groups = m.groupdict()
        name = groups.get("n") or groups.get("a") or groups.get("m")
        if not name or name.split("::")[-1] in NOT_NAMES:
            continue
        qualifier, kind = "", "definition"
        if family == "js" and groups.get("a"):
            at = m.end("arrow") - 1
            if bare[at] == "(" and "function" not in groups["arrow"]:
                end = _close(bare, at)
                if end >= 0 and not re.match(r"\s*(?::[^=;{]+(?:\{[^{}]*\})?)?\s*=>", bare[end:]):
                    continue
            elif bare[at] != "(":
                at = None
        elif family == "js" and groups.get("m"):
            at = m.start("mp")
            end = _close(bare, at)
            if m.start("m") == m.start() or end < 0 or not re.match(r"\s*(?::[^;={]+)?\s*\{", bare[end:]):
                continue
        else:
            at = m.start("p")
        end = _close(bare, at) if at is not None else m.end()
        params = bare[at + 1 : end - 1] if at is not None and end > 0 else ""
        rest = bare[end:].lstrip() if end > 0 else ""
        if family in ("java", "c"):
            kinds = (groups.get("t") or "").split()
            if any(w.rstrip("*&") in NOT_NAMES for w in kinds) or (family == "c" and not kinds):
                continue
            if family == "java" and not kinds and not groups["d"] and not rest.startswith(("{", "throws")):
                continue
            if family == "c":
                qualifier, _, name = name.rpartition("::")
            after = re.match(r"(?:throws\s+[\w.,\s]+|const\b|noexcept\b(?:\([^()]*\))?|override\b|final\b|&&?|->\s*[\w:<>*&,\s]+|=\s*(?:default|delete|0)|\s)*(?P<e>[{;:]?)", rest)
            if rest and not after["e"] and after.end() < len(rest) and not rest.startswith("default"):
                continue
            if after["e"] == ";":
                kind = "declaration"
            if after["e"] == ":" and family == "java":
                continue
        elif family == "js" and rest.startswith(";"):
            kind = "declaration"
        elif family == "go":
            qualifier = re.sub(r"[^\w]+", " ", groups.get("q") or "").split()[-1] if re.search(r"\w", groups.get("q") or "") else ""
        elif family == "rust" and re.match(r"(?:->[^;{]+)?(?:where[^;{]+)?;", rest):
            kind = "declaration"
        start = m.start() + len(m[0]) - len(m[0].lstrip("\n"))
        line = line_of(start)
        doc: list[str] | None
        if family == "python":
            doc = _docstring(text, bare, end) if end > 0 else None
        else:
            doc = _above(text, lines, line, family, comments, code)
        stop = _body_end(bare, end, family, start) if end > 0 else len(text)
        path = [x[2] for x in inside] + ([qualifier.replace("::", ".")] if qualifier else [])
        out.append((name, ".".join([*path, name]), _signature(params, family), kind, None if doc is None else "\n".join(doc).strip(), text[start:stop], _names(params, family), start, stop))
    return out


class _Lines:
    def __init__(self, starts: list[int]) -> None:
        self.starts = starts

    def __call__(self, at: int) -> int:
        import bisect

        return bisect.bisect_right(self.starts, at) - 1


def _docstring(text: str, bare: str, end: int) -> list[str] | None:
    m = re.compile(r"[ \t]*(?:->[^\n:]+(?:\[[^\]]*\])?)?[ \t]*:").match(bare, end)
    if not m:
        return None
    at = m.end()
    # comments and blank lines may stand before the first statement
    while True:
        n = re.compile(r"[ \t]*(?:#[^\n]*)?\n").match(text, at)
        if not n:
            break
        at = n.end()
    d = _DOCSTRING.match(text, at)
    if not d:
        return None
    return [x.strip() for x in (d["x"] if d["t"] else d["y"]).split("\n")]


def _body_end(bare: str, end: int, family: str, start: int) -> int:
    if family == "python":
        indent = len(re.match(r"[ \t]*", bare[bare.rfind("\n", 0, start) + 1 :])[0])
        for m in re.compile(r"\n(?=[^\n])").finditer(bare, end):
            stop = bare.find("\n", m.end())
            line = bare[m.end() : stop if stop >= 0 else len(bare)]
            before = m.start()
            while bare[before - 1] == "\n":
                before -= 1
            if line.startswith('"') and bare[before - 1] == '"':
                continue  # within a string of several lines
            if line.strip() and len(line) - len(line.lstrip()) <= indent:
                return m.start()
        return len(bare)
    m = re.compile(r"[^;{]*(?P<b>[;{])").match(bare, end)
    if not m:
        return len(bare)
    if m["b"] == ";":
        return m.end()
    stop = _close(bare, m.end() - 1)
    return stop if stop > 0 else len(bare)


def _split(params: str) -> list[str]:
    out, depth = [""], 0
    for c in params:
        depth += c in "([{<"
        depth -= c in ")]}>"
        if c == "," and depth == 0:
            out.append("")
        else:
            out[-1] += c
    return [x.strip() for x in out if x.strip() and x.strip() != "void"]


def _names(params: str, family: str) -> list[str]:
    """The names of the parameters."""
    out = []
    for p in _split(params):
        p = p.split("=")[0].strip()
        words = re.findall(r"[\w$]+", p.split(":")[0] if family in ("python", "js", "rust") else p)
        if words:
            out.append(words[0] if family == "go" else words[-1])
    return out


def _signature(params: str, family: str) -> str:
    """The types of the parameters, without names, defaults and blanks, by which overloads are told apart."""
    kinds = []
    for p in _split(params):
        p = p.split("=")[0].strip()
        if family in ("python", "js", "rust"):
            kinds.append(re.sub(r"\s+", "", p.partition(":")[2]) or "?")
        elif family == "go":
            kinds.append(re.sub(r"\s+", "", p.partition(" ")[2]) or "?")
        else:
            kinds.append(re.sub(r"\s+", "", re.sub(r"\b(?:const|final|register|struct)\b", "", re.sub(r"(?<=[\w>\]*& ])\b\w+(?=\s*(?:\[\])?$)", "", p) if " " in p or "*" in p or "&" in p else p)))
    return ",".join(kinds)


PLACEHOLDER = re.compile(r"^\W*(?:todo|fixme|tbd|tba|xxx|wip|n/?a|placeholder|undocumented|no (?:documentation|description|comment)|(?:missing|insert|add|write|put) (?:\w+ ){0,3}(?:documentation|description|docs?|comment)|documentation (?:goes|to come|follows)|lorem ipsum|see (?:above|below)|as above|auto-?generated)\b", re.I)
_PARAM = re.compile(r"^(?:@(?:param|arg|argument|return|returns|throws|exception|tparam|type)\b|:(?:param|parameter|arg|type|return|returns|rtype|raises?)\b|\\(?:param|return|brief\s*$)|[*-]\s*`?\w+`?\s*(?:-|:)|(?:args|arguments|parameters|params|returns?|raises|yields|throws)\s*:\s*$|#+\s*(?:arguments|parameters|returns|errors|panics|safety|examples?)\s*$)", re.I)


def _stem(word: str) -> str:
    w = word.lower()
    for end in ("ing", "ies", "es", "ed", "s", "e"):
        if w.endswith(end) and len(w) - len(end) >= 3:
            return w[: -len(end)].rstrip("e") if end != "ies" else w[:-3] + "y"
    return w


def _same_stem(a: str, b: str) -> bool:
    return a == b or (len(a) > 3 and len(b) > 3 and a[:-1] == b) or (len(a) > 3 and a == b[:-1])


def says_something(doc: str, name: str, params: list[str]) -> bool:
    """Whether documentation has four words beside parameter lines, other than those of the name, and is no placeholder."""
    kept, section = [], False
    for line in doc.split("\n"):
        line = line.strip()
        if _PARAM.match(line):
            section = bool(re.search(r":\s*$|^#", line)) and not line.startswith((":", "@"))
            continue
        if section and re.match(r"[*-]?\s*`?\w+`?(?:\s*\([^)]*\))?\s*(?::|-|—)", line):
            continue
        first = re.match(r"`?([\w$]+)`?\s*(?:is|are|:|-|–|—)(?:\s|$)", line)
        if first and first[1] in params:
            continue
        section = section and not line
        kept.append(line)
    text = " ".join(kept)
    words = [w for w in WORD.findall(text) if any(c.isalpha() for c in w)]
    if len(words) < 4 or PLACEHOLDER.match(text):
        return False
    own = {_stem(x) for x in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+", name)} | {name.lower()}
    return any(w.lower() not in ARTICLES and not any(_same_stem(_stem(w), o) for o in own) and w.lower() != name.lower() for w in words)


SYMBOLS = "revision_id long, language string, name string, qualified string, signature string, kind string, doc string, code string, says boolean"
_KINDS = [pa.int64(), *[pa.string()] * 7, pa.bool_()]


def symbols(chunks: DataFrame, per_block: int = 256) -> DataFrame:
    """The symbol table: one row per function of every revision that has code chunks (see ``functions_in``).

    A file is read in blocks of ``per_block`` chunks, one after the other in one task; what a block leaves open, a function or
    a comment whose function may follow, is carried into the next, so that no border cuts either and no file is held
    whole. Behind a border, names of enclosing classes are not known. ``symbol`` is not read, as it is often missing. The
    declared language is the chunk's ``locator.language``. Rows delivered twice count once; null texts are empty.
    """
    code = chunks.where("kind = 'code'").select("id", "revision_id", "ordinal", "text", F.col("locator.char_start").alias("char_start"), F.col("locator.line_start").alias("line_start"), F.lower("locator.language").alias("ext"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        at, carry, declared = None, "", None

        def keep(found: list[tuple]) -> None:
            rows.extend((at, declared, *f[:6], bool(f[4]) and says_something(f[4], f[0], f[6])) for f in found)

        def out() -> pa.RecordBatch:
            cols = list(zip(*rows)) if rows else [()] * len(_KINDS)
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, _KINDS)], names=[x.split()[0] for x in SYMBOLS.split(", ")])

        for batch in batches:
            for revision, ext, pieces in zip(*(c.to_pylist() for c in batch.columns)):
                text = "".join(p["text"] for p in pieces)
                if revision == at and at is not None:
                    done, hold = decided(MARK.sub("", carry), declared)
                    keep(done)
                    carry = MARK.sub("", carry)[hold:] + text
                else:
                    keep(functions_in(carry, declared))
                    at, carry, declared = revision, text, syntax.LANGUAGES.get((ext or "").lstrip("."))
            yield out()
        keep(functions_in(carry, declared))
        yield out()

    inside = blocks(code, ["ext"], per_block, by_file=True).sortWithinPartitions("revision_id", "block")
    return inside.select("revision_id", "ext", "pieces").mapInArrow(run, SYMBOLS)


def pairs(table: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """``(revision_id, func_name, qualified, signature, doc, code, own, doc_revision_id)``: pairs of code and documentation.

    Documented functions are joined with the separate definitions of the same root, qualified name, signature and language. A
    definition without documentation takes that of the declaration of the lowest revision; ``own`` is false then, and
    ``doc_revision_id`` says where the documentation stands. Every documented declaration is in a pair: with an undocumented definition,
    or else with its own code. Without ``roots`` (``revision_id`` to ``root_id``) each revision is a root of its own. Pairs whose
    documentation says nothing are left out; a null doc is none. Both sides are pre-aggregated by symbol before they meet.
    """
    key = ["root_id", "language", "qualified", "signature"]
    if roots is None:
        placed = table.withColumn("root_id", F.col("revision_id"))
    else:
        placed = table.join(roots.select("revision_id", "root_id").dropDuplicates(["revision_id"]), "revision_id", "left")
    shown = ["revision_id", F.col("name").alias("func_name"), "qualified", "signature", "doc", "code"]
    own = table.where("says and kind = 'definition'").select(*shown, F.lit(True).alias("own"), F.col("revision_id").alias("doc_revision_id"))
    declared = placed.where("says and kind = 'declaration'")
    lender = declared.groupBy(*key).agg(F.min(F.struct("revision_id", "doc")).alias("_l"))
    bare = placed.where("kind = 'definition' and doc is null")
    lent = bare.join(lender, key).withColumn("doc", F.col("_l.doc")).select(*shown, F.lit(False).alias("own"), F.col("_l.revision_id").alias("doc_revision_id"))
    body = bare.groupBy(*key).agg(F.min(F.struct("revision_id", "code")).alias("_b"))
    whole = declared.join(body, key, "left").join(lender.select(*key, F.col("_l.revision_id").alias("_first")), key, "left")
    whole = whole.where(F.col("_b").isNull() | ~F.col("revision_id").eqNullSafe(F.col("_first")))
    met = F.col("_b").isNotNull()
    rest = whole.select(F.coalesce("_b.revision_id", "revision_id").alias("revision_id"), F.col("name").alias("func_name"), "qualified", "signature", "doc", F.coalesce("_b.code", "code").alias("code"), (~met).alias("own"), F.col("revision_id").alias("doc_revision_id"))
    return own.unionByName(lent).unionByName(rest)


def documented(pairs_: DataFrame) -> DataFrame:
    """``(revision_id, func_name)``, each once: the documented functions where their documentation stands."""
    return pairs_.select(F.col("doc_revision_id").alias("revision_id"), "func_name").distinct()
