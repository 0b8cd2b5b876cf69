"""License expressions: AND, OR, WITH, + and brackets, put into postfix form and evaluated, as folds over an array of tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusforge.operators.license_ids import COPYLEFT, KNOWN_EXCEPTIONS, KNOWN_IDS, restrictiveness

_PRECEDENCE = {"or": 1, "and": 2, "with": 3}


def _mapping(pairs: dict[str, object]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def postfix(expression: str | Column) -> Column:
    """The expression's tokens with each operator after its operands, operators in lower case; null if it isn't well formed.

    WITH binds before AND, AND before OR; operators of one kind go from left to right. A null or blank text is not well formed.
    """
    text = F.col(expression) if isinstance(expression, str) else expression
    raw = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"([()]|[^\s()]+)"), 1)
    tokens = F.transform(raw, lambda t: F.when(F.lower(t).isin(list(_PRECEDENCE)), F.lower(t)).otherwise(t))
    binds = lambda t: F.coalesce(F.element_at(_mapping(_PRECEDENCE), t), F.lit(0))  # noqa: E731  a bracket binds nothing
    start = F.struct(F.array().cast("array<string>").alias("out"), F.array().cast("array<string>").alias("held"), F.lit(True).alias("wants"), F.lit(True).alias("ok"))

    def step(s: Column, t: Column) -> Column:
        top = F.reverse(s.held)
        opened = F.array_position(top, F.lit("(")).cast("int")
        weaker = F.array_position(F.transform(top, lambda h: binds(h) < binds(t)), F.lit(True)).cast("int")
        freed = F.when(weaker == 0, F.size(top)).otherwise(weaker - 1)
        made = lambda out, held, wants, ok: F.struct(out.alias("out"), held.alias("held"), F.lit(wants).alias("wants"), (s.ok & ok).alias("ok"))
        kept = lambda n: F.slice(s.held, F.lit(1), F.greatest(F.size(s.held) - n, F.lit(0)))
        return (
            F.when(t == "(", made(s.out, F.array_append(s.held, t), True, s.wants))
            .when(t == ")", made(F.concat(s.out, F.slice(top, F.lit(1), F.greatest(opened - 1, F.lit(0)))), kept(opened), False, ~s.wants & (opened > 0)))
            .when(binds(t) > 0, made(F.concat(s.out, F.slice(top, F.lit(1), freed)), F.array_append(kept(freed), t), True, ~s.wants))
            .otherwise(made(F.array_append(s.out, t), s.held, False, s.wants))
        )

    def end(s: Column) -> Column:
        return F.when(s.ok & ~s.wants & ~F.array_contains(s.held, "("), F.concat(s.out, F.reverse(s.held)))

    return F.aggregate(tokens, start, step, end)


def evaluate(expression: str | Column, ids: list[str] = KNOWN_IDS, exceptions: list[str] = KNOWN_EXCEPTIONS) -> Column:
    """valid, spdx_id, rank, strictest and copyleft of an expression; all but valid and copyleft are null where it isn't valid.

    Valid: well formed, every id known (whatever its case; with + after it if it names a version that isn't fixed by -only or
    -or-later), and WITH between one id and a known exception. spdx_id binds a user who may choose: of AND the more restrictive
    side, of OR the less restrictive one, of equal ones the first by name. strictest is the most restrictive id anywhere in it.
    """
    known, extra = _mapping({i.lower(): i for i in ids}), _mapping({e.lower(): e for e in exceptions})
    shape = "array<struct<kind: string, rank: int, id: string>>"
    term = lambda kind, rank, id_: F.struct(F.lit(kind).alias("kind"), rank.cast("int").alias("rank"), id_.alias("id"))
    start = F.struct(F.array().cast(shape).alias("stack"), F.lit(True).alias("ok"), F.struct(F.lit(-1).alias("rank"), F.lit(None).cast("string").alias("id")).alias("most"))

    def step(s: Column, t: Column) -> Column:
        right, left = F.get(s.stack, F.size(s.stack) - 1), F.get(s.stack, F.size(s.stack) - 2)
        rest = F.slice(s.stack, F.lit(1), F.greatest(F.size(s.stack) - 2, F.lit(0)))
        plain = F.regexp_replace(t, r"\+$", "")
        later = t.endswith("+")
        base = F.element_at(known, F.lower(plain))
        base = F.when(~(later & base.rlike("-(only|or-later)$")), base)
        rank = restrictiveness(base)
        leaf = F.when(base.isNotNull(), term("license", rank, F.concat(base, F.when(later, "+").otherwise("")))).otherwise(term("exception", F.lit(-1), F.element_at(extra, F.lower(t))))
        known_leaf = base.isNotNull() | F.element_at(extra, F.lower(t)).isNotNull()
        first = F.when((left.rank > right.rank) | ((left.rank == right.rank) & (left.id <= right.id)), left)
        stricter = F.coalesce(first, right)
        looser = F.when((left.rank < right.rank) | ((left.rank == right.rank) & (left.id <= right.id)), left).otherwise(right)
        joined = F.when(t == "with", term("term", left.rank, F.concat(left.id, F.lit(" WITH "), right.id))).when(t == "and", stricter).otherwise(looser)
        joined = F.struct(F.lit("term").alias("kind"), joined.rank.alias("rank"), joined.id.alias("id"))
        fits = F.when(t == "with", (left.kind == "license") & (right.kind == "exception")).otherwise((left.kind != "exception") & (right.kind != "exception"))
        is_op = t.isin(list(_PRECEDENCE))
        more = base.isNotNull() & ((rank > s.most.rank) | ((rank == s.most.rank) & (base < s.most.id)))
        return F.struct(
            F.when(is_op, F.array_append(rest, joined)).otherwise(F.array_append(s.stack, leaf)).cast(shape).alias("stack"),
            (s.ok & F.coalesce(F.when(is_op, fits).otherwise(known_leaf), F.lit(False))).alias("ok"),
            F.when(~is_op & more, F.struct(rank.cast("int").alias("rank"), base.alias("id"))).otherwise(s.most).alias("most"),
        )

    def end(s: Column) -> Column:
        only = F.get(s.stack, F.lit(0))
        valid = s.ok & F.coalesce(only.kind != "exception", F.lit(False))
        id_ = F.regexp_replace(F.regexp_replace(only.id, " WITH .*$", ""), r"\+$", "")
        return F.struct(valid.alias("valid"), F.when(valid, only.id).alias("spdx_id"), F.when(valid, only.rank).alias("rank"), F.when(valid, s.most.id).alias("strictest"), (valid & F.coalesce(id_.isin(COPYLEFT), F.lit(False))).alias("copyleft"))

    return F.coalesce(F.aggregate(postfix(expression), start, step, end), F.struct(F.lit(False).alias("valid"), F.lit(None).cast("string").alias("spdx_id"), F.lit(None).cast("int").alias("rank"), F.lit(None).cast("string").alias("strictest"), F.lit(False).alias("copyleft")))
