"""Lexers and local grammars of the languages whose files are checked.

A piece of a file is reduced to a *residue*: one letter per token, comments and blanks dropped, and every bracket group that
lies wholly within the piece checked by the grammar of its level and replaced by one letter. Residues of neighbouring
pieces concatenate and reduce further, so the reduction is associative. Because a piece may start within a comment or a
string, a piece has one residue per state that the lexer may be in at its start: a map from start state to end state and residue.

Letters: w name, n literal, P A B groups in (), [] and {}, ! a violation; keywords and operators by the tables below.
"""

from __future__ import annotations

import functools
import re

CODE, LINE, BLOCK, DOUBLE, SINGLE, BACK, TRIPLE_D, TRIPLE_S, DIRECTIVE = "c/*\"'`DS#"

#: Language by extension (fixed values); .h is C and .hpp C++, .jsx and .tsx are as JavaScript and TypeScript.
LANGUAGES = {"py": "python", "java": "java", "js": "js", "jsx": "js", "ts": "ts", "tsx": "ts", "c": "c", "h": "c", "cpp": "cpp", "hpp": "cpp", "go": "go", "rs": "rust", "sql": "sql"}

#: States in which a piece of a file may start, by language.
STATES = {
    "python": (CODE, LINE, DOUBLE, SINGLE, TRIPLE_D, TRIPLE_S),
    "java": (CODE, LINE, BLOCK, DOUBLE, TRIPLE_D),
    "js": (CODE, LINE, BLOCK, DOUBLE, SINGLE, BACK),
    "ts": (CODE, LINE, BLOCK, DOUBLE, SINGLE, BACK),
    "c": (CODE, LINE, BLOCK, DOUBLE, DIRECTIVE),
    "cpp": (CODE, LINE, BLOCK, DOUBLE, DIRECTIVE),
    "go": (CODE, LINE, BLOCK, DOUBLE, BACK),
    "rust": (CODE, LINE, BLOCK, DOUBLE),
    "sql": (CODE, LINE, BLOCK, SINGLE, DOUBLE),
}
#: What ends a state; a newline in a string of one line is a violation.
LEAVE = {
    LINE: re.compile(r"(?=\n)"),
    DIRECTIVE: re.compile(r"(?:[^\n\\]|\\[\s\S])*(?=\n)"),
    BLOCK: re.compile(r"\*/"),
    DOUBLE: re.compile(r'(?:[^"\\\n]|\\[\s\S])*"'),
    SINGLE: re.compile(r"(?:[^'\\\n]|\\[\s\S])*'"),
    BACK: re.compile(r"(?:[^`\\]|\\[\s\S])*`"),
    TRIPLE_D: re.compile(r'(?:[^"\\]|\\[\s\S]|"(?!""))*"""'),
    TRIPLE_S: re.compile(r"(?:[^'\\]|\\[\s\S]|'(?!''))*'''"),
}
MULTILINE = {"rust": {DOUBLE}, "sql": {SINGLE, DOUBLE}}
LEAVE_MULTI = {DOUBLE: re.compile(r'(?:[^"\\]|\\[\s\S])*"'), SINGLE: re.compile(r"[^']*'")}
LEAVE_SQL = {SINGLE: re.compile(r"[^']*'"), DOUBLE: re.compile(r'[^"]*"')}

_NAME = r"[^\W\d]\w*"
_NUMBER = r"(?:0[xXbBoO][\da-fA-F_]+|(?:\d[\d_]*(?:\.(?!\.)[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?)[a-zA-Z_]?\w{0,4}"
_DQ, _SQ = r'"(?:[^"\\\n]|\\[\s\S])*"', r"'(?:[^'\\\n]|\\[\s\S])*'"
_MARK = r"^(?:<{7}|={7}|>{7}|\|{7})(?![^\s])[^\n]*"

#: Keywords that the grammars name, and their letters; other keywords are names to them.
KEYWORDS = {
    "python": dict(zip("def class if elif else while for in return import from pass break continue try except finally with as raise lambda not and or is async await yield global nonlocal del assert None True False".split(), "DCFGLWOIRXYZZZtEHJKMNQVVUSSaggdvnnn")),
    "java": dict(zip("class interface enum record if else while for do switch case default return break continue try catch finally throw new package import static public private protected final abstract synchronized native instanceof throws extends implements void this super".split(), "CCCwFLWODSKQRZZTEHMNYXmmmmmmmmItxxvww")),
    "js": dict(zip("function class if else while for do switch case default return break continue try catch finally throw new import export from const let var async await of in instanceof typeof delete void static extends get set yield".split(), "fCFLWODSKQRZZTEHMNXYyVVVauIIIuuumxwwu")),
    "c": dict(zip("if else while for do switch case default return break continue goto struct union enum typedef static extern inline const volatile register unsigned signed sizeof".split(), "FLWODSKQRZZGUUUTmmmmmmttw")),
    "cpp": dict(zip("if else while for do switch case default return break continue goto struct union enum class typedef static extern inline const volatile constexpr unsigned signed sizeof namespace using template typename public private protected new delete throw try catch virtual explicit friend operator auto mutable noexcept override".split(), "FLWODSKQRZZGUUUUTmmmmmmttwjkHmaaaNuMYEmmmpwmee")),
    "go": dict(zip("func package import var const type struct interface map chan if else for range switch select case default return break continue goto defer go fallthrough".split(), "fpXVVTUUMMFLOrSSKQRZZGdds")),
    "rust": dict(zip("fn let mut pub use mod struct enum impl trait if else while for in loop match return break continue const static type where as unsafe async move ref dyn extern crate".split(), "flmpXMUUIIFLWOiDSRZZVVTeKuuurdpw")),
    "sql": {},
}
KEYWORDS["ts"] = KEYWORDS["js"] | dict(zip("interface type enum public private protected readonly declare abstract namespace implements as".split(), "JtUmmmmmmjxo"))
OPERATORS = {
    "->": "T", "=>": "A>", "::": ".", "?.": ".", "++": "i", "--": "i", "&&": "o", "||": "o", "==": "o", "!=": "o", "<=": "o", ">=": "o", "===": "o", "!==": "o", "<<": "o", "//": "o", "??": "o", "**": "x", "...": "~", "..": "o", "..=": "o", ":=": "=", "<-": "x",
    "+": "x", "-": "x", "*": "x", "&": "x", "!": "u", "~": "u", "/": "o", "%": "o", "|": "o", "^": "o", "=": "=", "@": "@", "#": "#", "$": "w", "<": "<", ">": ">", "?": "?", ":": ":", ".": ".", ",": ",", ";": ";", "(": "(", ")": ")", "[": "[", "]": "]", "{": "{", "}": "}",
}
OPERATORS["=>"] = "r"


def _lexer(language: str) -> re.Pattern:
    parts = [rf"(?P<mark>{_MARK})"]
    if language == "python":
        parts.append(r"(?P<line>\#[^\n]*)")
        prefix = r"(?:[rRbBuUfF]{1,2}(?=[\"']))?"
        parts.append(rf"""(?P<str>{prefix}(?:\"\"\"(?:[^"\\]|\\[\s\S]|"(?!""))*\"\"\"|'''(?:[^'\\]|\\[\s\S]|'(?!''))*'''|(?!\"\"\"|'''){_DQ}|(?!\"\"\"|'''){_SQ}))""")
        parts.append(rf"(?P<open>{prefix}(?:\"\"\"|'''|\"|'))")
        parts.append(r"(?P<join>\\\n)|(?P<nl>\n[ \t\f]*)")
    elif language == "sql":
        parts += [r"(?P<line>--[^\n]*)", r"(?P<block>/\*[\s\S]*?\*/)", r"(?P<bopen>/\*)", r"(?P<str>'[^']*'|\"[^\"]*\")", r"(?P<open>['\"])"]
    else:
        parts += [r"(?P<line>//[^\n]*)", r"(?P<block>/\*[\s\S]*?\*/)", r"(?P<bopen>/\*)"]
        if language in ("c", "cpp"):
            parts.append(r"(?P<pre>^[ \t]*\#[ \t]*[a-z]+\b(?:[^\n\\/]|\\[\s\S]|/(?![/*]))*)")
        if language == "java":
            parts.append(r'(?P<text>"""(?:[^"\\]|\\[\s\S]|"(?!""))*""")|(?P<topen>""")')
        if language in ("js", "ts", "go"):
            parts.append(r"(?P<tick>`(?:[^`\\]|\\[\s\S])*`)|(?P<kopen>`)")
        if language in ("js", "ts"):
            parts.append(r"(?P<regex>(?:(?<=[(,=:\[!&|?{};\n])|\A)[ \t]*/(?![/*\s])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*)")
        if language == "rust":
            parts.append(r"""(?P<raw>b?r(?P<h>#*)"[\s\S]*?"(?P=h))|(?P<life>'[^\W\d]\w*(?!'))""")
            parts.append(r"""(?P<str>b?"(?:[^"\\]|\\[\s\S])*"|b?'(?:[^'\\\n]|\\[^\n]{1,8}?)')""")
        else:
            parts.append(rf"(?P<str>(?:u8|[LuU])?{_DQ}|(?:[LuU])?{_SQ})" if language in ("c", "cpp") else rf"(?P<str>{_DQ}|{_SQ})")
        parts.append(r"(?P<open>[\"'])")
        if language in ("go", "js", "ts"):
            parts.append(r"(?P<nl>\n)")
    ops = sorted((o for o in OPERATORS if (o != "//" or language == "python") and (o != "::" or language != "python")), key=len, reverse=True)
    parts.append(rf"(?P<name>{_NAME})|(?P<num>{_NUMBER})|(?P<op>(?:{'|'.join(map(re.escape, ops))})=(?!=)(?<![=!<>:]=)|{'|'.join(map(re.escape, ops))})|(?P<odd>[^\s])")
    return re.compile("|".join(parts), re.M)


@functools.cache
def lexer(language: str) -> re.Pattern:
    return _lexer(language)


@functools.cache
def _letter(language: str):
    words = KEYWORDS[language]
    arrow = {"c": ".", "cpp": ".", "java": "r"}.get(language, "T")

    def letter(m: re.Match) -> str:
        kind = m.lastgroup
        if kind == "name":
            return words.get(m[0], "w") if language != "sql" else f" {m[0].upper()}{'_' if len(m[0]) == 1 else ''} "  # no name is one letter, as groups are
        if kind == "op":
            op = m[0]
            return arrow if op == "->" else OPERATORS.get(op) or "="
        if kind in ("str", "num", "text", "tick", "raw", "regex", "h"):
            return "n"
        if kind == "nl":
            text = m[0]
            return "\n" if language != "python" else "\n" + chr(0x2800 + min(len(text[1:].expandtabs()), 999))
        if kind in ("line", "block", "join", "pre", "life"):
            return ""
        return "!"  # a mark of an unfinished merge, or a character that no language has

    return letter


def read(text: str, start: str, language: str) -> tuple[str, str]:
    """``(end state, residue)`` of a text read from state ``start``; unfinished strings and comments are the end state."""
    pos, head = 0, ""
    if start != CODE:
        many = start in MULTILINE.get(language, ())
        leave = (LEAVE_SQL if language == "sql" else LEAVE_MULTI)[start] if many else LEAVE[start]
        m = leave.match(text) if start not in (LINE, BLOCK) else leave.search(text)
        if not m:
            if start in (DOUBLE, SINGLE) and not many and re.search(r"(?<!\\)\n", text):
                return CODE, "!"  # a string of one line runs over its end
            return start, ""
        pos = m.end()
        head = "n" if start not in (LINE, BLOCK, DIRECTIVE) else ""
    end = CODE
    text = text[pos:]
    # what stands open at the end: the last comment or string that does not close
    out: list[str] = []
    letter = _letter(language)
    for m in lexer(language).finditer(text):
        kind = m.lastgroup
        if kind in ("open", "bopen", "topen", "kopen"):
            if kind == "open":
                q = m[0].lstrip("rRbBuUfF")
                state = {'"': DOUBLE, "'": SINGLE, '"""': TRIPLE_D, "'''": TRIPLE_S}[q]
                if state in (DOUBLE, SINGLE) and state not in MULTILINE.get(language, ()) and re.search(r"(?<!\\)\n", text[m.end() :]):
                    out.append("!")
                    continue
            else:
                state = {"bopen": BLOCK, "topen": TRIPLE_D, "kopen": BACK}[kind]
            end = state
            break
        if kind in ("line", "pre") and m.end() == len(text):
            end = LINE if kind == "line" else DIRECTIVE
        out.append(letter(m))
    return end, reduce(head + "".join(out), language)


GROUP = re.compile(r"\(([^()\[\]{}]*)\)|\[([^()\[\]{}]*)\]|\{([^()\[\]{}]*)\}")


def reduce(residue: str, language: str) -> str:
    """Replaces bracket groups, innermost first, by the letter of a group, or ``!`` if their inside breaks the grammar."""
    if "!" in residue:
        return "!"
    inside = _inside(language)

    def one(m: re.Match) -> str:
        k = m.lastindex
        return inside("(["[k - 1] if k < 3 else "{", m[k])

    while True:
        shorter = GROUP.sub(one, residue)
        if shorter == residue:
            return residue
        if "!" in shorter:
            return "!"
        residue = shorter


@functools.cache
def _inside(language: str):
    grammar = GRAMMARS[language]()

    @functools.lru_cache(maxsize=200_000)
    def check(bracket: str, content: str) -> str:
        found = grammar.group(bracket, content)
        return found if isinstance(found, str) else {"(": "P", "[": "A", "{": "B"}[bracket] if found else "!"

    return check


def combine(left: dict[str, tuple[str, str]], right: dict[str, tuple[str, str]], language: str) -> dict[str, tuple[str, str]]:
    """The map of two neighbouring pieces from the maps of both; associative."""
    out = {}
    for start, (mid, a) in left.items():
        end, b = right.get(mid, (CODE, "!"))
        out[start] = (end, reduce(a + b, language))
    return out


def summary(text: str, language: str, first: bool) -> dict[str, tuple[str, str]]:
    """The state map of a piece; the first piece of a file starts in code."""
    return {s: read(text, s, language) for s in ((CODE,) if first else STATES[language])}


def valid(whole: dict[str, tuple[str, str]], language: str) -> bool:
    """Whether a file with this map, read from code, is syntactically valid."""
    end, residue = whole[CODE]
    return end in (CODE, LINE, DIRECTIVE) and "!" not in residue and not re.search(r"[()\[\]{}]", residue) and _whole(language, residue)


@functools.lru_cache(maxsize=200_000)
def _whole(language: str, residue: str) -> bool:
    return GRAMMARS[language]().file(residue)


# ---------------------------------------------------------------- local grammars


class Braces:
    """Grammar of a language with statements in braces, by regular expressions over the letters of one level."""

    statement = expression = group_round = group_square = group_curly = top = ""

    def __init__(self) -> None:
        # each statement is taken in one way only, so that no input makes the match retry combinations
        self._level = re.compile(rf"(?:(?>{self.statement}))*+")
        self._top = re.compile(rf"(?:(?>{self.top}))*+")
        self._round = re.compile(rf"(?:{self.group_round})")
        self._square = re.compile(rf"(?:{self.group_square})")
        self._curly = re.compile(rf"(?:{self.group_curly})") if self.group_curly else None

    def group(self, bracket: str, inside: str) -> bool:
        if bracket == "(":
            return bool(self._round.fullmatch(inside.replace("\n", "")))
        if bracket == "[":
            return bool(self._square.fullmatch(inside.replace("\n", "")))
        return bool(self._level.fullmatch(inside) or (self._curly and self._curly.fullmatch(inside.replace("\n", ""))))

    def file(self, residue: str) -> bool:
        return bool(self._top.fullmatch(residue))


def _expr(prim: str = "[wnPAB]", unary: str = "[xui]", binary: str = "[ox=<>?:]", post: str = r"(?:[PAi]|\.w)", generic: str = "") -> str:
    one = rf"{unary}*+(?:{prim})(?:{post}{generic})*+"
    return rf"{one}(?:{binary}{one})*+"


class C(Braces):
    # a cast is a group before an operand
    expression = _expr(prim=r"(?:P(?=[wnPxu]))*+(?:[wnPB])", unary=r"(?:[xui]|P(?=[wnxui]))")
    _type = r"[mt]*+(?:U?w|t|U(?:w?B))(?:[mt])*+x*+m*+"
    _declarator = rf"x*+(?:w|P(?=[PA]))(?:A)*+(?:=(?:{expression}|B)|:n)?"
    _decl = rf"(?:T)?{_type}(?:{_declarator}(?:,{_declarator})*+)?;"
    _fn = rf"{_type}x*+w?wP"
    statement = rf"(?:;|B|F[P]|L|WP(?:;)?|OP|D|SP|K{_expr(binary='[ox<>]')}:|Q:|R(?:{expression})?;|Z;|Gw;|w:(?!:)|{_decl}|{expression};)"
    top = rf"(?:{_fn}(?:B|;)|T?{_type}x*+P P?;|T?{_type}P?P;|T[mt]*+U?w?B?x*+w;|{_decl}|U w?B;|Uw?B(?:w(?:,w)*)?;|;)"
    group_round = rf"(?:{_type}(?:x|A|w|P)*+(?:,{_type}(?:x|A|w|P)*+)*+(?:,~)?|(?:{_decl}|{expression};|;)(?:{expression})?;(?:{expression}(?:,{expression})*+)?|(?:{expression}|{_type}x*+)(?:,(?:{expression}|{_type}x*+))*+|)"
    group_square = rf"(?:{expression})?"
    group_curly = rf"(?:(?:\.w(?:A)*=|A=)?(?:{expression}|B)(?:,(?:\.w(?:A)*=|A=)?(?:{expression}|B))*+,?)?"


class Cpp(Braces):
    _args = r"(?:<(?:[wtmxnUA.,P~]|<(?:[wtmxnUA.,P~]|<[wtmxnA.,]*>)*>)*>)"
    _name = rf"\.?w{_args}?(?:\.w{_args}?)*+(?:\.u?w)?"
    expression = _expr(prim=rf"(?:(?:P(?=[wnPxu]))*+(?:A P?B|AP?(?:\.w)?B|{_name}B?|[wnPB]|Nw(?:\.w)*{_args}?[PBA]?))", unary=r"(?:[xui]|P(?=[wnxui]))", post=rf"(?:[PAi]|\.{_name}|\.x?w)")
    _type = rf"(?:[mt]|YY)*+(?:U?{_name}|t|p|Uw?B)(?:[mt])*+[xo]*+m*+"
    _declarator = rf"[xo]*+w(?:A)*+(?:=(?:{expression}|B)|B|P|:n)?"
    _decl = rf"T?{_type}(?:A|{_declarator}(?:,{_declarator})*+)?(?:=(?:{expression}))?;"
    _tail = rf"(?:[mew]|eP)*+(?:\.{_type})?(?:=[nwQu])?"
    _template = r"(?:H(?:<(?:[wmtUAn.,=~x]|<[^<>]*>)*>)?)?"
    _fn = rf"(?:AA)?{_template}{_type}[xo]*+(?:{_name}|w?M?)P{_tail}"
    statement = rf"(?:;|B|Fm?P|L|WP;?|OP|D|SP|YB?|EP|K{_expr(binary='[ox<>]', prim=r'(?:w(?:.w)*|n|P)')}:|Q:|R(?:{expression}|B)?;|Z;|Gw;|MM?(?:{expression})?;|k[^;]*;|a:|{_fn}(?:;|B)|{_template}U\.?w(?:\.w)*m?(?::[m a]*{_name}(?:,[ma]*{_name})*)?B?;|{_decl}|{expression};|w:(?!:)|m?u?wP(?::wP(?:,w[PB])*)?(?:[me])*(?:=[wnQu])?(?:B|;))"
    top = rf"(?:m?j(?:{_name})?B|k[^;]*;|mB|;|{_fn}(?:;|B)|{_template}m*U\.?w(?:\.w)*m?(?::[ma]*{_name}(?:,[ma]*{_name})*)?B?;|{_template}{_decl}|Uw?B;|{_template}u?{_name}P(?::wP(?:,w[PB])*)?[me]*(?:=[wnQu])?(?:B|;)?)"
    group_round = rf"(?:(?:{_type}[xo]*+(?:w|P)?(?:A)*+(?:=(?:{expression}|B))?(?:,{_type}[xo]*+(?:w|P)?(?:A)*+(?:=(?:{expression}|B))?)*+(?:,~)?)|(?:{_decl}|{expression};|;)(?:{expression})?;(?:{expression}(?:,{expression})*+)?|{_type}[xo]*+(?:w|A):{expression}|~|(?:{expression}|{_type}[xo]*+|B)(?:,(?:{expression}|{_type}[xo]*+|B))*+|)"
    group_square = rf"(?:(?:=|x|{expression}|x?w)(?:,(?:{expression}|x?w))*+)?"
    group_curly = rf"(?:(?:\.w=)?(?:{expression}|B)(?:,(?:\.w=)?(?:{expression}|B))*+,?|w(?:=(?:{expression}))?(?:,w(?:=(?:{expression}))?)*+,?)?"


class Java(Braces):
    _args = r"(?:<(?:[w.,?&xA]|<(?:[w.,?&xA]|<(?:[w.,?xA]|<[w.,?xA]*>)*>)*>)*>)"
    _name = rf"w{_args}?(?:\.w{_args}?)*+"
    _type = rf"(?:{_name}|v)A*+"
    _note = r"(?:@w(?:\.w)*P?)"
    _lambda = r"(?:(?:w|P)r(?:B)?)"
    expression = _expr(prim=rf"(?:{_lambda}|N{_name}(?:PB?|A+B?)|SPB|w(?:\.w)*{_args}\.\w|[wnPB])", unary=rf"(?:[xui]|P(?=[wnPuN])|(?:w|P)r)", binary="[ox<>=?:]", post=rf"(?:[PAi]|\.(?:{_args})?w|\.C|\.N)")
    expression = rf"{expression}(?:I{_type}w?(?:o{expression})*)?"
    _decl = rf"(?:{_note}|m)*{_type}w A*".replace(" ", "") + rf"(?:=(?:{expression}|B))?(?:,wA*(?:=(?:{expression}|B))?)*;"
    _class = rf"(?:{_note}|m)*C w{_args}?P?(?:x{_type}(?:,{_type})*)*(?:w{_type}(?:,{_type})*)?B".replace(" ", "")
    _fn = rf"(?:{_note}|m|Q)*{_args}?{_type}wPA*(?:t{_type}(?:,{_type})*)?(?:B|Q?n?;)"
    _ctor = rf"(?:{_note}|m)*wP?(?:t{_type}(?:,{_type})*)?B"
    _members = rf"(?:{_class}|{_fn}|{_ctor}|{_decl}|m?B|;)"
    statement = rf"(?:;|B|FP|L|WP;?|OP|D|SP|TP?|EP|H|K(?:{expression})(?:,{expression})*(?::|r)|Q(?::|r)|R(?:{expression})?;|Zw?;|M{expression};|mP(?=B)|w:(?=[WODB])|{_decl}|{_class}|{expression};|{_members})"
    top = rf"(?:{_note}*Yw(?:\.w)*;|Xm?w(?:\.w)*(?:\.x)?;|{_class}|;)"
    group_round = rf"(?:(?:{_note}|m)*{_type}~?(?:w|w)?A*(?:,(?:{_note}|m)*{_type}~?wA*)*|(?:{_decl}|{expression};|;)(?:{expression})?;(?:{expression}(?:,{expression})*)?|m*{_type}w:{expression}|m*{_type}(?:o{_type})*w|(?:m*{_type}w={expression};?)+|(?:w=)?(?:{expression}|B)(?:,(?:w=)?(?:{expression}|B))*|)"
    group_square = rf"(?:{expression})?"
    group_curly = rf"(?:(?:{_note}*w P?B?(?:,{_note}*wP?B?)*,?(?:;(?:{_members})*)?)|(?:{expression}|B)(?:,(?:{expression}|B))*,?)?".replace("w P", "wP")


class JavaScript(Braces):
    """Newlines are letters: a statement ends at ; or at a line's end."""

    _type = ""  # JavaScript has no type annotations
    _param_type = ""
    _generic = ""
    _nl = r"\n*+"

    def __init__(self) -> None:
        n = self._nl
        kind = self._type
        note = rf"(?:\??:{n}{kind})?" if kind else ""
        ret = rf"(?::{n}{kind})?" if kind else ""
        gen = self._generic
        arrow = rf"(?:a?(?:w|{gen}P{ret}){n}r{n})"
        klass = rf"C(?:w{gen})?(?:x[w.P]+{gen})?(?:xw{gen}(?:,w{gen})*)*{n}[Bb]"
        func = rf"a?fx?w?{gen}P{ret}{n}B"
        new = rf"Nw(?:\.w)*{gen}P?"
        prim = rf"(?:{func}|{klass}|{new}|XP|[wnPABb]|m|Y(?=\.)|y(?=[.P])|o(?=[.P]))"
        unary = rf"(?:[xui]|{arrow}|~)"
        post = rf"(?:{gen}[PAi]|{n}\.{n}(?:[A-Za-z]|P|A)|n{'|u(?![wnP])' if kind else ''})"
        one = rf"{unary}*{prim}(?:{post}{n}(?=[\.])|{post})*"
        binary = r"[ox=<>?:I]"
        e = rf"{one}(?:{n}{binary}{n}{one})*"
        self.expression = e
        end = r"(?:;|(?=\n)|$)"
        binding = rf"(?:w|A|[Bb]){note}(?:{n}={n}(?:{e}))?"
        decl = rf"V{binding}(?:,{n}{binding})*{end}"
        imp = rf"X(?:n|(?:t?[Bb]|w(?:,{n}[Bb])?|x[wo]w){n}(?:y){n}n){end}"
        deco = rf"(?:@w(?:\.w)*P?{n})*"
        exp = rf"Y(?:[Bb](?:yn)?{end}|x(?:oww?)?(?:yn){end}|Q?(?=[fCVawNnPABJtUmni])|Q{n}(?:{e}){end})"
        extra = self._statements(n, end, kind)
        statement = rf"(?:\n|;|B|F{n}P|L|Wu?{n}P;?|Ou?{n}P|D|S{n}P|T|E{n}P?|H|K{n}(?:{e}):|Q:|R(?:{e})?{end}|Zw?{end}|M(?:{e}){end}|w:(?=[OWDB\n])|{decl}|{imp}|{exp}|{deco}{func}|{deco}{klass}|{extra}{e}(?:,{n}{e})*{end})"
        self.statement = statement
        self.top = statement
        pt = note
        param = rf"(?:{deco}m*~?(?:w|A|[Bb]){pt}(?:={e})?)"
        args = rf"(?:~?{e})(?:,(?:~?{e}))*,?"
        self.group_round = rf"(?:{param}(?:,{param})*,?|(?:{decl}|V?(?:{e})?;|;)(?:(?:{e})?;(?:{e}(?:,{e})*)?)|V(?:w|A|[Bb]){note}[uI](?:{e})|(?:w|V?w)[uI]{e}|V?(?:w|A|[Bb])w{e}|{args}|(?:w{note}))?"
        self.group_square = rf"(?:,*(?:~?{e})?(?:,+(?:~?{e}))*,*)"
        key = rf"(?:[A-Za-z]|n|A)"
        method = rf"(?:m|a|w|x)*(?:{key})\??{gen}P{ret}(?:B|;)?"
        prop = rf"(?:{key}\??:(?:{e})|{method}|~{e}|[A-Za-z](?:={e})?|[A-Za-z]o[A-Za-z])"
        field = rf"(?:{deco}[ma]*{key}[u?]?{note}(?:={e})?;?)"
        members = rf"(?:{deco}{method}|{field};?|mB|;)*"
        self.group_curly = rf"(?:{prop}(?:,{prop})*,?|{members}{self._members()})?"
        super().__init__()
        self._members_ = re.compile(rf"(?:\n|;|{deco}{n}{method}|{field}(?=[\n;]|$)|mB)*")

    def _statements(self, n: str, end: str, kind: str) -> str:
        return ""

    def _members(self) -> str:
        return ""

    def group(self, bracket: str, inside: str) -> bool | str:
        """An object or class body that is no block has the letter b, so that it cannot stand as a statement."""
        if bracket != "{":
            return super().group(bracket, inside)
        if self._level.fullmatch(inside):
            return True
        return "b" if self._members_.fullmatch(inside) or self._curly.fullmatch(inside.replace("\n", "")) else False


class TypeScript(JavaScript):
    _generic = r"(?:<(?:[wnAPB.,=x?:o]|<(?:[wnAPB.,=xo]|<[wnA.,]*>)*>)*>)?"
    _type = r"(?:(?:[wnu]|P\n*r\n*\w|P|A|[Bb]|\.|u)(?:<(?:[wnAPB.,xo]|<(?:[wnAPB.,xo]|<[wnA.,]*>)*>)*>)?(?:A|\.w|\n*[ox]\n*(?=[wnPABb]))?)+"

    def _statements(self, n: str, end: str, kind: str) -> str:
        return rf"m*Jw{self._generic}(?:x[w.,]+)?{n}[Bb]|m*tw{self._generic}{n}={n}{kind}{end}|m*V?Uw{n}[Bb]|m*j(?:w|n)(?:\.w)*{n}B|m+(?=[fCV])|".replace("U w", "Uw")


class Go(Braces):
    _type = r"(?:x|A|~|M(?:A)?)*(?:w(?:\.w)?A?|U B|UB|fP(?:P|w(?:\.w)?)?|M w|P)".replace("U B|", "").replace("M w|", "")
    _lit = rf"(?:(?:A|M A|MA)(?:x|A)*(?:w(?:\.w)?)(?=B)B|UBB|(?:A)+w?(?:\.w)?B)".replace("M A|", "")
    _func = rf"fP(?:P|{_type})?B"
    expression = _expr(prim=rf"(?:{_func}|MA{_type}(?:B)?|A+x*(?:w(?:\.w)?|UB|MA\w)(?:B|P)?|w(?:\.w)?B(?=[;,\n).]|$)|[wnP])", unary="[xu]", binary=r"[ox<>=:]\n*", post=r"(?:[PAi]|\.\n*(?:w|P))")
    _e = rf"(?:{expression})"
    _list = rf"{_e}(?:,\n*{_e})*+"
    _end = r"(?:;|\n|$)"
    _head = rf"(?:(?:{_list}|;)?;)?"
    _simple = rf"(?:(?:{_list}|V w)?)".replace("V w", "Vw")
    _cond = rf"(?:(?:[^;{{}}\n]*;)?[^;{{}}\n]+?)"
    _decl = rf"V(?:P|w(?:,w)*(?:{_type})?(?:=\n*{_list})?){_end}"
    _tdecl = rf"T(?:P|w(?:A)?=?(?:{_type}|UB)){_end}"
    _fn = rf"fP?w(?:A)?P(?:P|{_type})?(?:B)?{_end}"
    statement = rf"(?:\n|;|B{_end}|(?:F[^\n;BL]*(?:;[^\n;BL]*)?B\n?L?)|LB?{_end}|F{_cond}B(?:L(?:F{_cond})?B)*|O(?:[^\n;{{}}]*(?:;[^\n;{{}}]*;[^\n;{{}}]*)?)B{_end}|S[^\n{{}}]*B{_end}|K{_list}:|K[^\n]*:|Q:|R(?:{_list})?{_end}|Z w?{_end}|Gw{_end}|d{_e}{_end}|s{_end}|w:\n|{_decl}|{_tdecl}|{_list}(?:i)?{_end})".replace("Z w?", "Zw?")
    top = rf"(?:\n|;|pw{_end}|X(?:n|P|w n|\.n){_end}|{_fn}|{_decl}|{_tdecl})".replace("w n", "wn")
    group_round = rf"(?:(?:w(?:,w)*)?~?(?:{_type})(?:,(?:w(?:,w)*)?~?(?:{_type}))*,?|{_list}(?:~)?,?|(?:\n|n|w?n)*|{_type}(?:,{_e})*|)"
    group_square = rf"(?:{_e}?(?::{_e}?)*|~|{_type}|w{_type}(?:[,o]w?{_type})*|)"
    group_curly = rf"(?:(?:{_e}:)?(?:{_e}|B)(?:,(?:{_e}:)?(?:{_e}|B))*,?|)"

    def group(self, bracket: str, inside: str) -> bool:
        if bracket == "(" and "\n" in inside and all(re.fullmatch(rf"(?:w?n|\.n|w(?:,w)*(?:{self._type})?(?:={self._list})?|w(?:{self._type}|UB))?", x) for x in inside.split("\n")):
            return True
        if bracket == "{" and all(re.fullmatch(rf"(?:(?:w(?:,w)*)?{self._type}n?|w(?:,w)*UBn?|wP(?:P|{self._type})?|;)?", x) for x in inside.split("\n")):
            return True  # fields of a struct, methods of an interface
        return super().group(bracket, inside)


class Rust(Braces):
    _args = r"(?:<(?:[wn.,=xoArm+:]|P|T|d|<(?:[wn.,=xoA]|P|<[wn.,xA]*>)*>)*>)"
    _path = rf"\.?w(?:\.?{_args})?(?:\.w(?:\.?{_args})?)*+"
    _type = rf"(?:(?:x|m|d|xo)*(?:{_path}(?:P(?:T\w+)?)?|P|A|u|f P(?:Tw)?|I?w)(?:x{_path})*)".replace("f P", "fP")
    _mac = r"(?:\.?w(?:\.w)*u[PAB])"
    _pat = r"(?:(?:[wnPABxmr.,o~@<>=|]|\.\.)+)"
    _block = rf"(?:u*B|F(?:l{_pat}=)?[^;{{}}]+?B(?:L(?:F[^;{{}}]+?)?B)*|S[^;{{}}]+?B|(?:w:)?D B|(?:w:)?DB|(?:w:)?W(?:l{_pat}=)?[^;{{}}]+?B|(?:w:)?O{_pat}i[^;{{}}]+?B)".replace("D B|", "")
    _closure = rf"(?:u?o{_pat}?o?(?:T{_type})?)"
    expression = _expr(prim=rf"(?:{_mac}|F(?:l{_pat}=)?[^;{{}}BL]+?B(?:L(?:F[^;{{}}BL]+?)?B)+|S[^;{{}}B]+?B|u*B|DB|{_path}B(?=[,;).A]|$)|{_path}|[wnPA]|R(?=$|[,;])|Z)", unary=rf"(?:[xu]|xm|{_closure})", binary=rf"(?:[ox<>=]|>>|[ox]=)", post=rf"(?:[PA?]|\.(?:w|n)(?:\.{_args})?|K{_type})")
    _e = rf"(?:{expression})"
    _attr = r"(?:#u?A)*"
    _vis = r"(?:pP?)?"
    _fn = rf"{_attr}{_vis}[uVp n]*fw{_args}?P(?:T{_type})?(?:e[^B;]*)?(?:B|;)".replace("p n", "pn")
    _item = rf"(?:{_fn}|{_attr}{_vis}X[w.xPB]*(?:\.B|w w)?;|{_attr}{_vis}X[^;]*;|{_attr}{_vis}Mw(?:;|B)|{_attr}{_vis}Uw{_args}?(?:e[^B;]*)?(?:P?;|P?B)|{_attr}{_vis}[u]*I{_args}?[^;{{}}B]*B|{_attr}{_vis}Vm?w:{_type}={_e};|{_attr}{_vis}Tw{_args}?(?:=[^;]*)?;|\.?wuw?[PAB];?|#uA)"
    statement = rf"(?:;|{_item}|{_attr}l{_pat}(?::{_type})?(?:={_e}(?:LB)?)?;|R{_e}?;?|Zw?{_e}?;|{_block};?|{_e}(?:;|$))"
    top = rf"(?:;|{_item})"
    group_round = rf"(?:(?:{_attr}(?:x?m?x?w|m?{_pat}:{_type})(?:,{_attr}m?{_pat}:{_type})*,?)|(?:{_vis}{_type})(?:,{_vis}{_type})*,?|{_e}(?:,{_e})*,?|w(?:P|=n)?(?:,w(?:P|=n)?)*|{_pat}|)"
    group_square = rf"(?:{_e}(?:,{_e})*,?|{_e};{_e}|{_type};{_e}|{_type}|w(?:P|=n)(?:,w)*|)"
    group_curly = rf"(?:{_attr}{_vis}(?:w|n)(?::{_e})?(?:,{_attr}(?:w|n)(?::{_e})?)*(?:,oo?{_e})?,?|{_attr}{_vis}w:{_type}(?:,{_attr}{_vis}w:{_type})*,?|{_attr}w(?:P|B)?(?:=n)?(?:,{_attr}w(?:P|B)?(?:=n)?)*,?|(?:[\w.](?:,[\w.])*,?)|(?:(?:o?{_pat})(?:F{_e})?r(?:{_e},?|B,?))*)"


class Sql:
    """Statements by their clauses; names and keywords are words here."""

    _noise = frozenset("AS DISTINCT ALL".split())
    #: Words that cannot be names (fixed values of the grammar).
    reserved = frozenset("SELECT FROM WHERE GROUP ORDER BY HAVING LIMIT OFFSET UNION INTERSECT EXCEPT INSERT INTO VALUES UPDATE SET DELETE CREATE TABLE VIEW INDEX DROP ALTER JOIN ON USING AND OR NOT IN IS LIKE BETWEEN CASE WHEN THEN ELSE END AS DISTINCT ALL EXISTS WITH INNER LEFT RIGHT FULL CROSS OUTER UNIQUE PRIMARY KEY REFERENCES DEFAULT NULL CHECK CONSTRAINT FOREIGN ASC DESC".split())

    def group(self, bracket: str, inside: str) -> bool:
        if bracket == "{":
            return False
        if bracket == "[":
            return True
        t = self._tokens(inside)
        if not t:
            return True
        if t[0] in ("SELECT", "WITH", "VALUES"):
            return self._query(t)
        return all(self._expr(x) or self._column(x) for x in self._split(t, ","))

    def file(self, residue: str) -> bool:
        statements = self._split(self._tokens(residue), ";")
        return all(self._statement(t) for t in statements if t)

    @staticmethod
    def _tokens(text: str) -> list[str]:
        return re.findall(r"[^\W\d]\w{1,}|(?<= )[^\W\d](?= )|\S", text)

    @staticmethod
    def _split(t: list[str], by: str) -> list[list[str]]:
        out: list[list[str]] = [[]]
        for x in t:
            if x == by:
                out.append([])
            else:
                out[-1].append(x)
        return out

    def _name(self, x: str) -> bool:
        return (x[0].isalpha() or x[0] == "_") and x not in self.reserved and x != "P" or x in ("n", "DATE", "KEY")

    def _code(self, t: list[str]) -> str:
        kinds = {"AND": "o", "OR": "o", "LIKE": "o", "ILIKE": "o", "IN": "o", "NOT": "u", "BETWEEN": "o", "IS": "s", "NULL": "0", "CASE": "C", "WHEN": "W", "THEN": "H", "ELSE": "L", "END": "E", "EXISTS": "u", "DISTINCT": "u", "AS": "a", "ASC": "d", "DESC": "d", "DEFAULT": "0", "INTERVAL": "u", "OVER": "v", "REGEXP": "o", "GLOB": "o", "COLLATE": "o", "ESCAPE": "o", "ALL": "u", "ANY": "w"}
        out = []
        for x in t:
            if x in kinds:
                out.append(kinds[x])
            elif x in ("n", "P", "A", ".", ":", "x", "o", "=", "<", ">", "u", "!"):
                out.append({"<": "o", ">": "o", "=": "o", "A": "P"}.get(x, x))
            elif x in self.reserved or not (x[0].isalpha() or x[0] == "_"):
                out.append("!")
            else:
                out.append("w")
        return "".join(out)

    _one = r"(?:[xu]*(?:w(?:\.(?:w|x))*P?(?:vP|vw)?|n|0|P|x(?=$|a)|C[^E]*E)(?:::?w)?)"
    _EXPR = re.compile(rf"{_one}(?:(?:o+|x|us?o|uo|:)o?x?u?{_one}|su?0|su?w)*(?:a(?:w|n)|w|n)?(?:d(?:ww)?)?")

    def _expr(self, t: list[str]) -> bool:
        return bool(t) and bool(self._EXPR.fullmatch(self._code(t)))

    def _column(self, t: list[str]) -> bool:
        """A column or constraint of a table's definition."""
        if len(t) < 2:
            return False
        if t[0] in ("PRIMARY", "UNIQUE", "FOREIGN", "CHECK", "CONSTRAINT"):
            return "P" in t
        if not self._name(t[0]) or not self._name(t[1]):
            return False
        rest = " ".join(t[2:])
        return bool(re.fullmatch(r"(?:\s*(?:P|PRECISION|VARYING|UNSIGNED|PRIMARY KEY|AUTOINCREMENT|AUTO_INCREMENT|NOT NULL|NULL|UNIQUE|DEFAULT (?:x )?(?:n|\w+)(?: P)?|REFERENCES \w+(?: P)?|ON (?:DELETE|UPDATE) \w+(?: NULL)?|CHECK P|COLLATE \w+|WITH(?:OUT)? TIME ZONE|GENERATED ALWAYS AS (?:IDENTITY|P)|ASC|DESC))*\s*", rest))

    def _list(self, t: list[str]) -> bool:
        return all(self._expr(x) for x in self._split(t, ","))

    def _from(self, t: list[str]) -> bool:
        text = " ".join(t)
        parts = re.split(r"\s*(?:,|\b(?:(?:NATURAL )?(?:INNER|CROSS|(?:LEFT|RIGHT|FULL)(?: OUTER)?) )?JOIN\b)\s*", text)
        for p in parts:
            head, on, cond = p.partition(" ON ")
            head, using, _ = head.partition(" USING")
            if not re.fullmatch(r"(?:P|A|n|[A-Z_]\w*(?: \. \w+)*(?: P)?)(?: AS)?(?: (?!SELECT|FROM|WHERE)\w+)?(?: P)?", head.strip()) or head.strip().split()[0] in self.reserved:
                return False
            if on and not self._expr(cond.split()):
                return False
        return True

    def _query(self, t: list[str]) -> bool:
        if t[0] == "WITH":
            text = " ".join(t)
            m = re.match(r"WITH (?:RECURSIVE )?\w+(?: P)? AS (?:(?:NOT )?MATERIALIZED )?P(?: , \w+(?: P)? AS P)* (?=SELECT|INSERT|UPDATE|DELETE)", text)
            return bool(m) and self._statement(text[m.end() :].split())
        if t[0] == "VALUES":
            return all(x == ["P"] for x in self._split(t[1:], ","))
        text = " ".join(t)
        for part in re.split(r" (?:UNION|INTERSECT|EXCEPT)(?: ALL| DISTINCT)? ", text):
            m = re.fullmatch(r"(?:P|SELECT (?:(?:DISTINCT|ALL) )?(?P<s>.+?)(?: FROM (?P<f>.+?))?(?: WHERE (?P<w>.+?))?(?: GROUP BY (?P<g>.+?))?(?: HAVING (?P<h>.+?))?(?: ORDER BY (?P<o>.+?))?(?: LIMIT (?P<l>\S+))?(?: OFFSET \S+)?)", part)
            if not m:
                return False
            if m["s"] is None:
                continue
            if not self._list(m["s"].split()) or (m["f"] and not self._from(m["f"].split())):
                return False
            if any(m[k] is not None and not self._list(m[k].split()) for k in "wgho"):
                return False
        return True

    def _statement(self, t: list[str]) -> bool:
        text = " ".join(t)
        if t[0] in ("SELECT", "WITH", "VALUES"):
            return self._query(t)
        for pattern in (
            r"INSERT (?:OR \w+ )?INTO \w+(?: \. \w+)?(?: P)? (?:VALUES P(?: , P)*|DEFAULT VALUES|(?P<q>(?:SELECT|WITH) .+))(?: ON CONFLICT.*)?(?: RETURNING .+)?",
            r"UPDATE \w+(?: \. \w+)? SET (?P<set>.+?)(?: WHERE (?P<w>.+))?",
            r"DELETE FROM \w+(?: \. \w+)?(?: WHERE (?P<w>.+))?",
            r"CREATE (?:(?:TEMP|TEMPORARY) )?TABLE (?:IF NOT EXISTS )?\w+(?: \. \w+)? (?:P(?: \w+)*|AS (?P<q>.+))",
            r"CREATE (?:OR REPLACE )?(?:TEMP )?VIEW (?:IF NOT EXISTS )?\w+(?: P)? AS (?P<q>.+)",
            r"CREATE (?:UNIQUE )?INDEX (?:IF NOT EXISTS )?\w+ ON \w+(?: USING \w+)? P(?: WHERE (?P<w>.+))?",
            r"DROP (?:TABLE|VIEW|INDEX|SCHEMA) (?:IF EXISTS )?\w+(?: \. \w+)?(?: CASCADE)?",
            r"ALTER TABLE \w+(?: \. \w+)? (?:ADD|DROP|RENAME|ALTER) .+",
            r"(?:BEGIN|COMMIT|ROLLBACK|END)(?: TRANSACTION| WORK)?|START TRANSACTION|PRAGMA .+|(?:GRANT|REVOKE) .+ ON .+ (?:TO|FROM) \w+|TRUNCATE (?:TABLE )?\w+|ANALYZE(?: \w+)?|VACUUM(?: \w+)?|USE \w+|SET \w+ (?:=|TO) .+",
        ):
            m = re.fullmatch(pattern, text)
            if m:
                got = m.groupdict()
                if got.get("q") and not self._query(got["q"].split()):
                    return False
                if got.get("w") and not self._expr(got["w"].split()):
                    return False
                return not got.get("set") or all(len(x) > 2 and x[1] == "=" and self._expr(x[2:]) for x in self._split(got["set"].split(), ","))
        return False


class Python:
    """Logical lines by their form, blocks by their indentation."""

    def __init__(self) -> None:
        unary = r"(?:[xu]|Q|S)*+"
        one = rf"{unary}(?:n++|[wPAB~])(?:[PA]|\.[A-Za-z])*+"
        binary = r"(?:[ox<>]|QI|I|UQ?|V|F|L)"
        lam = r"(?:N(?:x?w?(?:=[wn])?(?:,x?w(?:=[wn])?)*):)"
        e = rf"(?:{lam}*{one}(?:{binary}{lam}*{one})*)"
        star = rf"(?:x?{e}|a(?:Y?{e})?)"
        many = rf"(?:{star}(?:,{star})*,?)"
        target = rf"(?:x?{one}(?:,x?{one})*,?)"
        names = r"(?:w(?:\.w)*(?:Kw)?(?:,w(?:\.w)*(?:Kw)?)*)"
        simple = rf"(?:{many}(?:={many})*|{one}:{e}(?:={many})?|R{many}?|M(?:{e}(?:Y{e})?)?|X{names}|Y[.~o]*(?:w(?:\.w)*)?X(?:x|P|{names})|Z|d{target}|v{e}(?:,{e})?|gw(?:,w)*)"
        self._simple = re.compile(rf"{simple}(?:;{simple})*;?")
        header = rf"(?:S?DwA?P(?:T{e})?|CwA?P?|[FGW]{e}|L|t|Ex?(?:{many}(?:Kw)?)?|H|S?O{target}I{many}|S?J{e}(?:K{one})?(?:,{e}(?:K{one})?)*|w{many})"
        self._header = re.compile(rf"{header}:((?:{simple}(?:;{simple})*;?)?)")
        self._deco = re.compile(rf"@{e}")
        comp = rf"(?:S?O{target}I{e}(?:F{e}|S?O{target}I{e})*)"
        item = rf"(?:x?x?{e}(?:{comp})?|w={e}|x?x?w:{e}(?:={e})?|o|x|a(?:Y?{e})?)"
        self._round = re.compile(rf"(?:{item}(?:,{item})*,?)?")
        part = rf"(?:{e}?(?::{e}?)?(?::{e}?)?)"
        self._square = re.compile(rf"(?:x?{part}(?:,x?{part})*,?|{e}{comp})?")
        self._curly = re.compile(rf"(?:(?:x?{e}|{e}:{e})(?:,(?:x?{e}|{e}:{e}))*,?|{e}(?::{e})?{comp})?")

    _blank = re.compile("[\n\u2800-\u2be7]")

    def group(self, bracket: str, inside: str) -> bool:
        inside = self._blank.sub("", inside)
        return bool({"(": self._round, "[": self._square, "{": self._curly}[bracket].fullmatch(inside))

    def file(self, residue: str) -> bool:
        levels, opened = [0], False
        for line in ("\u2800" + residue).split("\n"):
            indent, code = ord(line[0]) - 0x2800, line[1:]
            if not code:
                continue
            if opened:
                if indent <= levels[-1]:
                    return False
                levels.append(indent)
            elif indent != levels[-1]:
                while levels and indent < levels[-1]:
                    levels.pop()
                if not levels or indent != levels[-1]:
                    return False
            opened = False
            m = self._header.fullmatch(code)
            if m:
                opened = not m[1]
            elif not (self._simple.fullmatch(code) or self._deco.fullmatch(code)):
                return False
        return not opened


GRAMMARS = {k: functools.cache(v) for k, v in {"python": Python, "java": Java, "js": JavaScript, "ts": TypeScript, "c": C, "cpp": Cpp, "go": Go, "rust": Rust, "sql": Sql}.items()}
