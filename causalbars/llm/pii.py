"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causalbars.llm.common import put


@dataclass(frozen=True)
class Kind:
    """One kind of span.

    ``pattern`` may use possessive quantifiers: they match the same spans as greedy ones here, because what follows a
    repeated part can never be part of it, and neither backtrack nor recurse on very long texts.
    ``hint`` is a string that a text must contain to be searched; ``check`` is SQL over the match ``m``.
    A span is kept if ``score``, plus ``context_bonus`` where one of ``context`` stands near, reaches the threshold.
    """

    name: str
    pattern: str
    check: str
    score: float
    hint: str = ""
    context: tuple[str, ...] = ()
    context_bonus: float = 0.2
    base: bool = False


_DIGITS = "regexp_replace(m, '[^0-9]', '')"
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: Remainder modulo 97 of a number in which letters count 10 to 35, its first four characters moved to the end.
_MOD97 = (
    "aggregate(split(concat(substring(replace(m, ' ', ''), 5), left(replace(m, ' ', ''), 4)), ''), 0, "
    "(r, c) -> if(c = '', r, if(c between '0' and '9', (r * 10 + ascii(c) - 48) % 97, (r * 100 + ascii(c) - 55) % 97)))"
)
_LOCAL, _LABEL = "A-Za-z0-9._%+-", "A-Za-z0-9-"

#: In the order of the result; the base kinds are always kept.
KINDS = (
    Kind(
        "email",
        # A match may begin at the start of a run of local characters, or where the match before it ended.
        rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[{_LABEL}]++(?:\.[{_LABEL}]++)++",
        "true",
        0.9,
        hint="@",
        context=("mail", "contact", "write"),
        base=True,
    ),
    Kind(
        "ip",
        r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        rf"m rlike '^{_PART}(?:[.]{_PART}){{3}}$'",
        0.6,
        hint=".",
        context=("ip", "address", "host", "server"),
        base=True,
    ),
    Kind(
        "card",
        r"[0-9](?:[\x20-]?[0-9])++",
        f"length({_DIGITS}) between 16 and 19 and luhn_check({_DIGITS})",
        0.8,
        context=("card", "visa", "credit", "karte", "carte", "tarjeta"),
        base=True,
    ),
    Kind(
        "phone",
        r"\+[0-9][\x20().0-9-]+[0-9]",
        f"length({_DIGITS}) between 8 and 15",
        0.6,
        hint="+",
        context=("phone", "call", "tel", "mobile"),
        base=True,
    ),
    Kind(
        "iban",
        r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)",
        f"length(replace(m, ' ', '')) between 15 and 34 and {_MOD97} = 1",
        0.7,
        context=("iban", "account", "konto", "compte", "cuenta"),
    ),
    Kind("secret", r"AKIA[0-9A-Z]{16}|password=[0-9A-Za-z]{6,64}", "true", 0.7, context=("key", "login", "secret")),
    Kind(
        "id_number",
        r"[0-9](?:[\x20-]?[0-9])++",
        f"length({_DIGITS}) between 6 and 19 and not (length({_DIGITS}) >= 16 and luhn_check({_DIGITS}))",
        0.2,
        context=("ssn", "passport", "social security", "tax id", "account", "ausweis", "konto", "passeport", "cuenta"),
        context_bonus=0.5,
    ),
)
THRESHOLD = 0.5
#: Characters before and after a span in which context words count.
NEAR = 40
_RUN = 512


def _positions(text: str, matches: str, pattern: str) -> str:
    """SQL: struct(m, s, e) of all matches from the texts between them.

    Results are gathered in runs of 512, so that many matches in one long text don't copy a long array each time.
    """
    one = "named_struct('m', x.m, 's', a.p + x.g, 'e', a.p + x.g + length(x.m))"
    step = (
        "named_struct('p', a.p + x.g + length(x.m), "
        f"'done', if(size(a.run) < {_RUN}, a.done, concat(a.done, array(a.run))), "
        f"'run', if(size(a.run) < {_RUN}, concat(a.run, array({one})), array({one})))"
    )
    kind = "array<struct<m:string,s:int,e:int>>"
    start = f"named_struct('p', 0, 'done', cast(array() as array<{kind}>), 'run', cast(array() as {kind}))"
    gaps = f"transform(slice(split({text}, '{pattern}', -1), 1, size({matches})), g -> length(g))"
    return (
        f"if(size({matches}) = 0, cast(array() as {kind}), aggregate("
        f"zip_with({matches}, {gaps}, (m, g) -> named_struct('m', m, 'g', g)), {start}, "
        f"(a, x) -> {step}, a -> flatten(concat(a.done, array(a.run)))))"
    )


def find_spans(docs: DataFrame, text: str = "text", kinds: tuple[Kind, ...] = KINDS, threshold: float = THRESHOLD) -> DataFrame:
    """Adds pii_spans: an array of struct(kind, start, end, score, base), by kind as listed, then start.

    Matches of one kind are leftmost and do not overlap; a match that fails its checksum or length is dropped and
    not tried again shorter.  ``start`` and ``end`` count code points, the end is exclusive.  Base kinds stay whatever
    their score; others need ``threshold``.  Everything is built-in functions on one row: no shuffle, no Python.

    A null or empty text has an empty array; repeated rows are alike; an empty table stays empty;
    an input column named pii_spans is replaced.
    """
    work = docs.withColumn("_text", F.coalesce(F.col(f"`{text}`"), F.lit("")))
    for i, kind in enumerate(kinds):
        pattern = kind.pattern.replace("\\", "\\\\").replace("'", "\\'")
        found = f"regexp_extract_all(_text, '{pattern}', 0)"
        if kind.hint:
            found = f"if(contains(_text, '{kind.hint}'), {found}, cast(array() as array<string>))"
        work = work.withColumn(f"_m{i}", F.expr(found))
        check = kind.check.replace("\\", "\\\\")
        spans = f"filter(transform({_positions('_text', f'_m{i}', pattern)}, x -> named_struct('x', x, 'm', x.m)), v -> {_bind(check)})"
        words = " or ".join(f"contains(near, '{w}')" for w in kind.context) or "false"
        near = f"lower(concat(substring(_text, greatest(v.x.s - {NEAR}, 0) + 1, least(v.x.s, {NEAR})), ' ', substring(_text, v.x.e + 1, {NEAR})))"
        scored = (
            f"transform({spans}, v -> named_struct('kind', '{kind.name}', 'start', v.x.s, 'end', v.x.e, 'score', "
            f"transform(array({near}), near -> if({words}, {min(1.0, round(kind.score + kind.context_bonus, 6))}D, {kind.score}D))[0], "
            f"'base', {str(kind.base).lower()}))"
        )
        work = work.withColumn(f"_s{i}", F.expr(f"if(size(_m{i}) = 0, cast(array() as array<struct<kind:string,start:int,end:int,score:double,base:boolean>>), filter({scored}, s -> s.base or s.score >= {threshold}D))"))
    out = put(work, pii_spans=F.concat(*[F.col(f"_s{i}") for i in range(len(kinds))]))
    return out.drop("_text", *[f"_{p}{i}" for i in range(len(kinds)) for p in "ms"])


def _bind(check: str) -> str:
    """The check reads the match as ``m``: bind it once, as the struct field of the span."""
    return f"transform(array(v.m), m -> {check})[0]"


def spans_text(spans: Column) -> Column:
    """kind:start:end of all spans, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def mask_spans(found: DataFrame, text: str = "text") -> DataFrame:
    """Replace what ``find_spans`` found by the kind in angle brackets and drop pii_spans.

    Of spans that overlap, the one that starts first (of those, the longest) names the replacement, which covers
    all of them.  A null text stays null; n_chars is set anew where the table has it.
    """
    ordered = F.expr("array_sort(transform(pii_spans, s -> named_struct('s', s.start, 'n', -s.end, 'k', s.kind)))")
    step = (
        "named_struct('p', greatest(a.p, -x.n), 'out', "
        "if(x.s >= a.p, concat(a.out, array(substring(_text, a.p + 1, x.s - a.p), concat('<', x.k, '>'))), a.out))"
    )
    masked = (
        "aggregate(_ordered, named_struct('p', 0, 'out', cast(array() as array<string>)), "
        f"(a, x) -> {step}, a -> concat(array_join(a.out, ''), substring(_text, a.p + 1)))"
    )
    work = found.withColumn("_text", F.col(f"`{text}`")).withColumn("_ordered", ordered)
    new = F.when(F.size("_ordered") == 0, F.col("_text")).otherwise(F.expr(masked))
    work = work.withColumn("_new", new)
    changed = {text: F.col("_new")}
    if "n_chars" in found.columns:
        changed["n_chars"] = F.when(F.size("_ordered") == 0, F.col("n_chars")).otherwise(F.length("_new").cast("long"))
    columns = [changed[c].alias(c) if c in changed else F.col(f"`{c}`") for c in found.columns if c != "pii_spans"]
    return work.select(*columns)
