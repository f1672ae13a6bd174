"""Definitions with their spans, and calls, in languages that mark blocks by braces, or by indentation and ``end``.

A file is read in three linear steps: comments and strings become blanks of the same length, brackets are paired, and
definition heads are looked for in what is left; a definition ends where its body's brace does, or with its line if it has none. What is in
comments and strings is seen by nobody, and a brace in them closes nothing. No grammar: macros that open blocks are read as calls.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from typing import NamedTuple


class Tag(NamedTuple):
    name: str
    kind: str
    tag: str
    line: int
    end: int


# How languages write comments and strings.
LINE, BLOCK, DOUBLE, SINGLE, TICKS, TRIPLE = r"//[^\n]*", r"/\*.*?(?:\*/|\Z)", r'"(?:\\.|[^"\\\n])*(?:"|$)', r"'(?:\\.|[^'\\\n])*(?:'|$)", r"`(?:\\.|[^`\\])*(?:`|\Z)", r'""".*?(?:"""|\Z)'
SLASHES = r"(?<=[=(,:;!&|?{}\[\n])[ \t]*/(?![/*])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/"
RAW_RUST, CHAR = r'\br(#*)".*?(?:"\1|\Z)', r"'(?:\\[^\n]{1,8}?|[^'\\\n])'"
BLANKS = {
    "javascript": (LINE, BLOCK, DOUBLE, SINGLE, TICKS, SLASHES), "go": (LINE, BLOCK, DOUBLE, CHAR, r"`[^`]*(?:`|\Z)"), "rust": (LINE, BLOCK, RAW_RUST, DOUBLE, CHAR),
    "java": (LINE, BLOCK, TRIPLE, DOUBLE, CHAR), "c": (LINE, BLOCK, DOUBLE, CHAR, r"^[ \t]*#(?:\\\n|[^\n])*"), "c_sharp": (LINE, BLOCK, r'@"(?:""|[^"])*(?:"|\Z)', DOUBLE, CHAR),
    "php": (LINE, r"#(?!\[)[^\n]*", BLOCK, DOUBLE, SINGLE), "kotlin": (LINE, BLOCK, TRIPLE, DOUBLE, CHAR), "scala": (LINE, BLOCK, TRIPLE, DOUBLE, CHAR),
    "ruby": (r"^=begin\b.*?(?:^=end\b|\Z)", r"#[^\n]*", DOUBLE, SINGLE),
}
BLANKS |= {"typescript": BLANKS["javascript"], "cpp": BLANKS["c"]}
#: Languages whose block comments lie in one another.
NESTED = ("rust", "kotlin", "scala")
READ = {k: re.compile("|".join(f"(?:{p})" for p in v), re.S | re.M) for k, v in BLANKS.items()}

# Words that open a type, and how a function's head is known: by a word before its name, or by what is between its parameters and its brace.
TYPES = {
    "javascript": "class", "typescript": "class|interface|enum|namespace", "go": None, "rust": "struct|enum|trait|union|mod", "java": "class|interface|enum|record", "c": "struct|enum|union",
    "cpp": "class|struct|enum(?: +class)?|union|namespace", "c_sharp": "class|interface|enum|struct|record|namespace", "php": "class|interface|trait|enum", "kotlin": "class|interface|object", "scala": "class|object|trait",
}
HEADS = {"javascript": "function", "typescript": "function", "go": "func", "rust": "fn", "php": "function", "kotlin": "fun", "scala": "def"}
BETWEEN = {
    "javascript": r"\s*(?::[^;{}=()]{0,2000})?\{", "typescript": r"\s*(?::[^;{}=()]{0,2000})?\{", "java": r"\s*(?:throws\s+[\w.,\s<>]{0,2000})?\{", "c": r"\s*\{", "c_sharp": r"\s*(?::\s*(?:base|this)\s*\([^)]*\)\s*)?(?:where\s+[^{;]{0,2000})?\{",
    "cpp": r"\s*(?:(?:const|noexcept|override|final|volatile|mutable|&&?)\s*)*(?:->\s*[\w:<>,*&\s]{0,2000})?(?::[^;{}]{0,2000})?\{",
}
NOT_NAMES = frozenset("if for while switch catch return else do try function func fn fun def new delete throw await typeof sizeof foreach using lock match when unless until elif with super this self base and or not in is as case synchronized defer go select assert print".split())
CALL = re.compile(r"(?<![\w$@])([A-Za-z_]\w*)\s*(?:<[^<>()\n]{0,80}>\s*)?\(")
#: What stands before a name that is declared rather than called: a type. Not so these words.
TYPED, NOT_TYPES = re.compile(r"([A-Za-z_][\w.:<>,\[\]]*)[\s*&]+$"), frozenset("return new throw else await yield case delete goto in is as typeof not and or".split())
#: A head has no more characters than this between name and brace.
HEAD = 2_000
STOP = re.compile(r"[\n;(\[{]")
ARROW = re.compile(r"\b(?:const|let|var)\s+(\w+)\s*(?::[^=;{}]+)?=\s*(?:async\s*)?(?:\([^()]*\)|\w+)\s*(?::[^=;{}]+)?=>\s*")
GO_TYPE = re.compile(r"^type\s+(\w+)(?:\[[^\]]*\])?\s+(\w+)?", re.M)
RUBY = re.compile(r"^([ \t]*)(class|module|def)\s+(?:self\.)?([A-Za-z_]\w*[?!=]?)", re.M)
RUBY_CALL = re.compile(r"(?<![\w@$:])([a-z_]\w*[?!]?)(?=\()|(?<=\.)([a-z_]\w*[?!]?)")


def blanked(text: str, language: str) -> str:
    """The text with comments and strings made of blanks; line ends stay."""
    wipe = lambda s: re.sub(r"[^\n]", " ", s)
    if language not in NESTED:
        return READ[language].sub(lambda m: wipe(m[0]), text)
    out, at = [], 0
    while m := READ[language].search(text, at):
        out.append(text[at : m.start()])
        end = m.end()
        if m[0].startswith("/*"):  # comments in comments: go on until as many have closed as have opened
            depth, end = 1, m.start() + 2
            while depth and (x := re.compile(r"/\*|\*/").search(text, end)):
                depth, end = depth + (1 if x[0] == "/*" else -1), x.end()
            end = len(text) if depth else end
        out.append(wipe(text[m.start() : end]))
        at = end
    return "".join(out) + text[at:]


def paired(text: str) -> dict[int, int]:
    """Where each bracket closes; one that doesn't closes at the end. A bracket that closes another kind also closes what is open inside it."""
    close, opened = {")": "(", "]": "[", "}": "{"}, []
    out: dict[int, int] = {}
    open_of = {"(": 0, "[": 0, "{": 0}
    for m in re.finditer(r"[()\[\]{}]", text):
        c, i = m[0], m.start()
        if c in open_of:
            opened.append((c, i))
            open_of[c] += 1
        elif open_of[close[c]]:
            while opened:
                kind, at = opened.pop()
                open_of[kind] -= 1
                out[at] = i
                if kind == close[c]:
                    break
    return out | {at: len(text) for _, at in opened}


def brace_tags(text: str, language: str) -> list[Tag]:
    code = blanked(text, language)
    pairs, ends = paired(code), [m.start() for m in re.finditer("\n", code)]
    line = lambda i: bisect_right(ends, i - 1) if i else 0
    found: dict[int, tuple[str, str, int]] = {}  # where a name stands: name, kind, where its body ends

    def brace(at: int, between: str = rf"[^;{{}}]{{0,{HEAD}}}\{{") -> int | None:
        m = re.compile(between).match(code, at)
        return m.end() - 1 if m else None

    def body(at: int, between: str = rf"[^;{{}}]{{0,{HEAD}}}\{{") -> int | None:
        i = brace(at, between)
        return None if i is None else pairs[i]

    def to_line_end(at: int) -> int:
        while m := STOP.search(code, at, at + HEAD):
            if m[0] in "\n;":
                return m.start()
            at = pairs.get(m.start(), m.start()) + 1
        return min(at + HEAD, len(code))

    blocks: list[tuple[int, int]] = []  # types, and what else makes a function a method
    if TYPES[language]:
        for m in re.finditer(rf"(?<![\w.:])(?:{TYPES[language]})\s+(?:\[\[[^\]]*\]\]\s*)?([A-Za-z_]\w*)", code):
            after = m.end()
            if language in ("kotlin", "scala"):  # parameters, and a brace on the same line or none
                x = re.compile(r"\s*(?:[<\[][^(){}\n]{0,200}[>\]]\s*)?(?=\()").match(code, after)
                after = pairs.get(x.end(), after) + 1 if x else after
                end = body(after, rf"[^;{{}}\n=]{{0,{HEAD}}}\{{")
            else:
                end = body(after)
            if end is not None or language in ("kotlin", "scala", "rust", "java", "c_sharp"):
                found[m.start(1)] = (m[1], "class", end if end is not None else to_line_end(after))
    else:
        for m in GO_TYPE.finditer(code):
            end = body(m.end(1), rf"[^;{{}}\n]{{0,{HEAD}}}\{{")
            found[m.start(1)] = (m[1], "class" if m[2] in ("struct", "interface") else "type", end if end is not None else to_line_end(m.end(1)))
    if language == "rust":
        for m in re.finditer(r"(?<!\w)impl\b", code):
            end = body(m.end())
            blocks += [(m.start(), end)] if end is not None else []
    if language in HEADS:
        head = rf"\b{HEADS[language]}\b\s*(\([^()]*\)\s*|<[^>(]*>\s*|&|\*)?(?:\w+\.)?([A-Za-z_]\w*)\s*(?:[<\[][^(){{}}]{{0,200}}[>\]]\s*)?(\(?)"
        for m in re.finditer(head, code):
            after = pairs.get(m.end() - 1, m.end() - 1) + 1 if m[3] else m.end()
            end = body(after, rf"[^;{{}}={chr(92)}n]{{0,{HEAD}}}=?\s*\{{" if language in ("kotlin", "scala") else rf"[^;{{}}]{{0,{HEAD}}}\{{")
            if end is None and not m[3] and language != "scala":
                continue
            received = language == "go" and (m[1] or "").startswith("(")
            found[m.start(2)] = (m[2], "method" if received else "function", end if end is not None else to_line_end(after))
    if language in ("javascript", "typescript"):
        for m in ARROW.finditer(code):
            end = pairs[m.end()] if code[m.end() : m.end() + 1] == "{" else to_line_end(m.end())
            found[m.start(1)] = (m[1], "function", end)
    calls, until = [], 0
    for m in CALL.finditer(code):
        name, at = m[1], m.start(1)
        if name in NOT_NAMES or at in found or at < until:
            continue
        before = code[max(0, at - 200) : at]
        typed = TYPED.search(before)
        typed = typed is not None and typed[1] not in NOT_TYPES
        if language in BETWEEN:
            close = pairs.get(m.end() - 1, len(code))
            opens = brace(close + 1, BETWEEN[language]) if close < len(code) and not re.search(r"(?:\.|->|\b(?:new|return|throw|else|await))\s*$", before) else None
            if opens is not None:
                found[at] = (name, "function", pairs[opens])
                until = opens  # what initializes members before the brace is neither defined nor called
                continue
            if typed and language not in ("javascript", "typescript") and re.compile(r"\s*(?:const\s*)?;").match(code, close + 1):
                continue  # declared without a body
        calls.append((at, name))
    blocks = sorted(blocks + [(at, end) for at, (_, kind, end) in found.items() if kind == "class"])
    out, opened = [], []
    at_block = 0
    for at in sorted(found):
        name, kind, end = found[at]
        while at_block < len(blocks) and blocks[at_block][0] < at:
            opened.append(blocks[at_block][1])
            at_block += 1
        while opened and opened[-1] < at:
            opened.pop()
        kind = "method" if kind == "function" and opened else kind
        out.append((at, Tag(name, kind, "def", line(at), line(min(end, max(len(code) - 1, 0))))))
    out += [(at, Tag(name, "call", "ref", line(at), line(at))) for at, name in calls]
    return [t for _, t in sorted(out)]


def ruby_tags(text: str) -> list[Tag]:
    """Ruby's blocks end with an ``end`` that stands no deeper than what it ends."""
    code = blanked(text, "ruby")
    lines = code.split("\n")
    ends = [m.start() for m in re.finditer("\n", code)]
    closing = [(i, len(s) - len(s.lstrip())) for i, s in enumerate(lines) if re.match(r"\s*end\b", s)]
    places = [i for i, _ in closing]
    out, names = [], set()
    for m in RUBY.finditer(code):
        begin = bisect_right(ends, m.start(2) - 1) if m.start(2) else 0
        one_line = re.search(r"(?:;|\s)end\s*$", lines[begin])
        end = begin if one_line else next((i for i, indent in closing[bisect_right(places, begin) :] if indent <= len(m[1])), len(lines) - 1)
        out.append((m.start(3), Tag(m[3], "class" if m[2] != "def" else "method", "def", begin, end)))
        names.add(m.start(3))
    for m in RUBY_CALL.finditer(code):
        name, at = m[1] or m[2], m.start()
        if at not in names and name not in NOT_NAMES and name not in ("end", "class", "module", "begin", "then", "puts"):
            out.append((at, Tag(name, "call", "ref", bisect_right(ends, at - 1) if at else 0, bisect_right(ends, at - 1) if at else 0)))
    return [t for _, t in sorted(out)]


def tags_of(text: str | None, language: str) -> list[Tag]:
    """Definitions and calls in the order of the text, lines 0-based. An unknown language has none."""
    if not text or language not in BLANKS:
        return []
    return ruby_tags(text) if language == "ruby" else brace_tags(text, language)
