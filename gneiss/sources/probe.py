"""What language a file without an extension is written in, by its first bytes: shebang, then the look of its lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gneiss.functions import paths as P

# Interpreters, and how lines of three languages begin, with what that counts.
INTERPRETERS = {"python": "python", "python2": "python", "python3": "python", "python3.11": "python", "node": "javascript", "nodejs": "javascript", "deno": "javascript", "bun": "javascript", "ruby": "ruby", "php": "php"}
SHELLS = "sh bash zsh fish ksh dash ash perl".split()
LOOKS = {
    "python": [(r"^(import |from |def |class |async def )", 2), (r"^(@|return |raise |yield )", 1), (r"^(if |elif |else:|for |while |with |try:|except |finally:|match |case )", 1), (r"__main__", 3)],
    "javascript": [(r"^(import |export |const |let |var |function )", 2), (r"=>|require\(|module\.exports", 1)],
    "ruby": [(r"^(require |def |class |module )", 2), (r"^(end|begin)$|^attr_", 1)],
}
LINES, ENOUGH = 40, 3


def probe(path: Column, head: Column) -> Column:
    """struct<language, is_code> of a file. ``head``: its first 4,096 bytes; null counts as unreadable."""

    def out(language: Column | str | None, is_code: bool) -> Column:
        return F.struct((language if isinstance(language, Column) else F.lit(language).cast("string")).alias("language"), F.lit(is_code).alias("is_code"))

    text = F.when(F.is_valid_utf8(head.cast("string")) & (F.instr(head.cast("string"), "\0") == 0), head.cast("string"))
    first = F.regexp_extract(F.split(text, r"\r?\n")[0], r"^#!\s*(.*)$", 1)
    words = F.transform(F.filter(F.split(first, r"\s+"), lambda w: w != ""), lambda w: F.lower(P.name(w)))
    called = F.when(F.get(words, F.lit(0)) == "env", F.get(F.filter(F.slice(words, 2, 100), lambda w: ~w.startswith("-")), F.lit(0))).otherwise(F.get(words, F.lit(0)))
    named = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in INTERPRETERS.items() for x in kv]), called), F.when(called.startswith("python"), "python"))
    lines = F.slice(F.filter(F.transform(F.split(text, r"\r?\n"), F.trim), lambda x: x != ""), 1, LINES)

    def points(language: str) -> Column:
        of = lambda x: sum((F.when(x.rlike(p), n).otherwise(0) for p, n in LOOKS[language]), F.lit(0))
        return F.aggregate(F.transform(lines, of), F.lit(0), lambda a, x: a + x)

    known = P.language(path)
    plain = F.regexp_replace(F.lower(P.stem(path)), "[^a-z0-9]", "")
    return (
        F.when(P.suffix(path) != "", F.when(known.isNotNull(), out(known, True)).otherwise(out(None, False)))
        .when(plain.rlike("^(" + "|".join(P.DOC_STEMS) + ")"), out(None, False))
        .when(F.lower(P.name(path)).isin(P.SOURCE_NAMES), out(None, True))
        .when(text.isNull() | (text == ""), out(None, False))
        .when(named.isNotNull(), out(named, True))
        .when(called.isin(SHELLS), out(None, True))
        .when(F.contains(F.array_join(F.slice(lines, 1, 12), "\n"), F.lit("<?php")), out("php", True))
        .when(points("python") >= ENOUGH, out("python", True))
        .when(points("javascript") >= ENOUGH, out("javascript", True))
        .when(points("ruby") >= ENOUGH, out("ruby", True))
        .otherwise(out(None, False))
    )
