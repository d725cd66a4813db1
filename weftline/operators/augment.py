"""Variants of function sources and their verification."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.functions import rules
from weftline.functions import solidity as sol
from weftline.functions.rules import BUILTIN_GLOBALS
from weftline.functions.text import source_hash

# The steps of each of the five variants, in order.
RECIPES = {
    1: ["rename", "literals"], 2: ["clean", "inject_start"], 3: ["literals", "inject_end"],
    4: ["rename", "clean"], 5: ["rename", "literals", "inject_start", "clean"],
}
#: White space as the JVM's expressions have it.
_SPACE = re.compile("[\\t\\n\\x0b\\f\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")


def renamed(t: sol.Tokens, src: str, suffix: str, keep: set[str]) -> tuple[str, dict[str, str]]:
    """Local variables get a suffix, but for names in ``keep``, call receivers and member names; also
    the new names with the old ones."""
    names = set(sol.local_types(t)) - keep - set(BUILTIN_GLOBALS) - {c["receiver"] for c in sol.member_calls(t, src)}
    out, last = [], 0
    for i, (x, kind) in enumerate(zip(t.text, t.kind)):
        if kind == "id" and x in names and not (i and t.text[i - 1] == "."):
            out += [src[last : t.start[i]], f"{x}_{suffix}"]
            last = t.end[i]
    return "".join([*out, src[last:]]), {f"{x}_{suffix}": x for x in names}


def cleaned(src: str) -> str:
    """T2, as ``text.clean_comments`` has it."""
    bare = re.sub(r"/\*.*?\*/", "", re.sub(r"//[^\n]*", "", src), flags=re.S)
    lines = (_SPACE.sub(" ", x).strip(" ") for x in re.split(r"\r\n|[\n\r]", bare))
    return "\n".join(x for x in lines if x)


def swapped(src: str) -> str:
    """T3, as ``text.swap_literals`` has it."""
    zero = re.sub(r"\b0x0\b", "address(0)", src)
    out = zero if zero != src else src.replace("address(0)", "0x0")
    wide = re.sub(r"\buint\b", "uint256", out)
    return wide if wide != out else re.sub(r"\buint256\b", "uint", out)


def inject(src: str, at_start: bool, seed: int) -> str:
    """T4: an inert statement right after the body's opening or before its closing brace."""
    # fixed value: the form of the statement
    t = sol.scan(src)
    for i, x in enumerate(t.text):
        if x == "{" and t.partner[i] > i:
            at = t.end[i] if at_start else t.start[t.partner[i]]
            return f"{src[:at]}\n        uint256 _inert_val_{seed} = {seed} + {seed + 1};\n{src[at:]}"
    return src


def structure(src: str, names: set[str], types: dict[str, str]) -> dict:
    """What a source accesses and calls, by one scan: sorted ``vars`` among ``names``, ``calls`` with the declared
    types of their receivers, ``events`` in order, and whether it parses."""
    t = sol.scan(src)
    local = sol.local_types(t)
    calls = [
        (c["call_text"], c["method"], c["receiver"], local.get(c["receiver"], types.get(c["receiver"])),
         "local" if c["receiver"] in local else "state" if c["receiver"] in types else None, c["is_cast"])
        for c in sol.member_calls(t, src)
    ]
    return {
        "tokens": t, "vars": sorted({x for _, x in sol.accesses(t, names, local)}), "calls": calls,
        "events": sol.events(t, src, names, local), "parsed": t.matched and "function" in t.text,
    }


def variant_of(src: str, tokens: sol.Tokens, number: int, seed: int, keep: set[str]) -> tuple[str, dict[str, str]]:
    """T5: the source by one recipe, and the new names with the old ones."""
    names: dict[str, str] = {}
    for step in RECIPES[number]:
        if step == "rename":
            src, names = renamed(tokens, src, f"aug{number}", keep)
        elif step == "clean":
            src = cleaned(src)
        elif step == "literals":
            src = swapped(src)
        else:
            src = inject(src, step == "inject_start", seed)
    return src, names


_CALL = pa.struct([
    ("call_text", pa.string()), ("method", pa.string()), ("receiver", pa.string()), ("receiver_type", pa.string()),
    ("scope", pa.string()), ("is_cast", pa.bool_()),
])
_CALLS = "array<struct<call_text:string,method:string,receiver:string,receiver_type:string,scope:string,is_cast:boolean>>"


def variants(items: DataFrame, id_col: str, text: str, label: str, state_vars: str, types: str | None = None) -> DataFrame:
    """Every variant of every item with a text: ``<id_col>, variant, variant_source, parsed, n_vars,
    same_vars, same_order, calls, own_calls, error, is_variant, transforms_applied``.

    Five variants of positives, two of the rest. An original is scanned once, a variant once; what is
    compared and not kept stays in the task. ``types`` is a map of state variables to their types. An
    exception in one variant gives its type as ``error`` and nulls, and touches no other row. Names are compared
    after whole names that were given a suffix are put back.
    """
    kind = items.schema[id_col].dataType.simpleString()
    columns = [F.col(id_col), F.col(text), F.col(label).cast("int"), F.col(state_vars)] + ([F.col(types)] if types else [])
    fields = ["variant", "variant_source", "parsed", "n_vars", "same_vars", "same_order", "calls", "own_calls", "error"]
    arrow = [pa.int32(), pa.string(), pa.bool_(), pa.int32(), pa.bool_(), pa.bool_(), pa.list_(_CALL), pa.list_(_CALL), pa.string()]
    as_dicts = lambda calls: [dict(zip(("call_text", "method", "receiver", "receiver_type", "scope", "is_cast"), c)) for c in calls]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which, rows = [], []
            for i, (key, src, positive, names, *own_types) in enumerate(zip(*(c.to_pylist() for c in batch.columns))):
                known, declared = set(names or []), dict(own_types[0] or {}) if own_types else {}
                base = key if isinstance(key, int) else zlib.crc32(str(key).encode())
                for number in range(1, 6 if positive == 1 else 3):
                    which.append(i)
                    try:
                        if number == 1:
                            own = structure(src, known, declared)
                        new, back = variant_of(src, own["tokens"], number, base * 100 + number, known)
                        got = structure(new, known, declared)
                        order = [(e, back.get(x, x)) for e, x in got["events"]]
                        rows.append((
                            number, new, got["parsed"], len(got["vars"]), got["vars"] == own["vars"], order == own["events"],
                            as_dicts(got["calls"]), as_dicts(own["calls"]), None,
                        ))
                    except Exception as e:  # one bad text must not end the task
                        rows.append((number, None, None, None, None, None, None, None, type(e).__name__))
            cols = list(zip(*rows)) if rows else [[] for _ in arrow]
            out = [batch.column(0).take(pa.array(which, pa.int64())), *(pa.array(c, a) for c, a in zip(cols, arrow))]
            yield pa.RecordBatch.from_arrays(out, names=["__id", *fields])

    schema = f"__id {kind}, variant int, variant_source string, parsed boolean, n_vars int, same_vars boolean, same_order boolean, calls {_CALLS}, own_calls {_CALLS}, error string"
    # the work is in the tasks, not in their bytes: as many even ones as the session shuffles by
    even = items.select(*columns).where(F.col(text).isNotNull()).repartition(int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")), id_col)
    made = even.mapInArrow(run, schema)
    return made.select(
        F.col("__id").alias(id_col), *fields, F.lit(True).alias("is_variant"),
        F.array(F.concat(F.lit("transform_"), F.col("variant").cast("string"))).alias("transforms_applied"),
    )


def source_id(*candidates: Column, id_: Column) -> Column:
    """Where a variant comes from: the first candidate that is not empty, else the item's number."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in candidates], F.concat(F.lit("train_"), id_.cast("string")))


def external(calls: Column) -> Column:
    """The calls of ``variants`` that leave the contract, as an array of ``kind, target`` structs; the target is the
    contract type called, null for calls told by their method."""
    def one(c: Column) -> Column:
        kind = rules.classify_call(c["method"], c["receiver"], c["receiver_type"], c["scope"], c["is_cast"])
        return F.struct(kind.alias("kind"), rules.type_of_call(kind, c["receiver"], c["receiver_type"]).alias("target"))

    return F.filter(F.transform(calls, one), lambda x: x["kind"].isNotNull())


def verify(variants_: DataFrame, id_col: str, own_hash: DataFrame, eval_hashes: DataFrame, contract: str | None = None) -> DataFrame:
    """``<id_col>, variant, reason`` of ``variants``; a null reason means accepted.

    ``own_hash`` has ``<id_col>, own_hash`` and, if given, the name of each item's ``contract``; the contracts that
    the original calls count as those of its bundle. ``eval_hashes`` has ``hash``. The checks run in a fixed
    order; a variant whose hash equals its original's, or that of an earlier accepted variant of the
    same item, is a duplicate. An exception is a reason of its own.
    """
    v = variants_.withColumns({"hash": source_hash(F.col("variant_source")), "now": external(F.col("calls")), "was": external(F.col("own_calls"))})
    # written once: classification and hash are not worked out again by each check
    v = v.select(id_col, "variant", "variant_source", "parsed", "n_vars", "same_vars", "same_order", "hash", "now", "was", "error")
    own = F.col(contract) if contract else F.lit("")
    there = F.transform("was", lambda c: c["target"])
    cross = lambda calls: rules.is_cross_contract(F.transform(calls, lambda c: c["target"]), there, own)
    leaks = eval_hashes.select("hash").distinct().withColumn("leak", F.lit(True))
    joined = v.join(own_hash, id_col).join(leaks, "hash", "left")
    reason = (
        F.when(F.col("error").isNotNull(), F.concat(F.lit("exception_"), F.col("error")))
        .when(F.col("hash") == F.col("own_hash"), "duplicate_variant")
        .when(F.trim("variant_source") == "", "empty_source")
        .when(~F.col("parsed"), "parse_failure")
        .when((F.col("n_vars") == 0) | (F.size("now") == 0), "not_constructable")
        .when(F.size("now") != F.size("was"), "call_count_mismatch")
        .when(~F.col("same_vars"), "state_vars_mismatch")
        .when(cross("now") != cross("was"), "cross_contract_mismatch")
        .when(~F.col("same_order"), "sequence_order_changed")
        .when(F.col("leak"), "eval_leakage_collision")
    )
    return first_accepted(joined.withColumn("reason", reason), id_col, "variant", "hash").select(id_col, "variant", "reason")


def first_accepted(df: DataFrame, item: str, order: str, key: str) -> DataFrame:
    """Of the rows without a reason and with equal ``key`` in an item, all but the first become
    ``duplicate_variant``; a rejected row does not use up the key. A row with a reason that repeats
    an accepted key is a duplicate too, since that check comes first."""
    first = F.min(F.when(F.col("reason").isNull(), F.col(order))).over(Window.partitionBy(item, key))
    return df.withColumn("reason", F.when(first < F.col(order), "duplicate_variant").otherwise(F.col("reason")))

