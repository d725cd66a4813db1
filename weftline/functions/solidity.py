"""A small scanner for Solidity: contracts, functions, calls and accesses.

It works on tokens with bracket matching, not on a grammar. Broken input never raises: unmatched
brackets end at the end of the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

from weftline.functions.rules import BUILTIN_GLOBALS

_TOKEN = re.compile(
    r"""(?P<skip>\s+|//[^\n]*|/\*.*?\*/|/\*.*\Z)|(?P<str>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*')"""
    r"""|(?P<id>[A-Za-z_$][\w$]*)|(?P<num>\d[\w.]*)|(?P<op>=>|\+\+|--|(?:<<|>>|[-+*/%|&^])=|[=!<>]=|&&|\|\||<<|>>|.)""",
    re.S | re.X,
)
ASSIGN = {"=", "+=", "-=", "*=", "/=", "%=", "|=", "&=", "^=", "<<=", ">>="}
OPEN, CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}
# Words of the language that are neither types nor names.
WORDS = {
    "memory", "storage", "calldata", "public", "private", "internal", "external", "view", "pure",
    "payable", "constant", "immutable", "override", "virtual", "returns", "return", "indexed",
    "if", "else", "for", "while", "do", "try", "catch", "new", "delete", "emit", "revert",
    "unchecked", "assembly", "using", "import", "pragma", "function", "modifier", "constructor",
    "event", "error", "struct", "enum", "is", "break", "continue", "true", "false",
}


@dataclass
class Tokens:
    text: list[str] = field(default_factory=list)
    kind: list[str] = field(default_factory=list)
    start: list[int] = field(default_factory=list)
    end: list[int] = field(default_factory=list)
    partner: list[int] = field(default_factory=list)
    outer: list[int] = field(default_factory=list)  # the innermost bracket open around each token, -1 for none
    matched: bool = True


def scan(src: str) -> Tokens:
    t, stack = Tokens(), []
    for m in _TOKEN.finditer(src):
        if m.lastgroup == "skip":
            continue
        i = len(t.text)
        t.text.append(m.group())
        t.kind.append(m.lastgroup)
        t.start.append(m.start())
        t.end.append(m.end())
        t.partner.append(-1)
        t.outer.append(stack[-1] if stack else -1)
        if m.lastgroup == "op":
            if m.group() in OPEN:
                stack.append(i)
            elif m.group() in CLOSE:
                if stack and OPEN[t.text[stack[-1]]] == m.group():
                    j = stack.pop()
                    t.partner[i], t.partner[j] = j, i
                else:
                    t.matched = False
    for j in stack:
        t.partner[j] = len(t.text) - 1
        t.matched = False
    return t


def _declared(t: Tokens, a: int, b: int) -> tuple[str, str] | None:
    """``type, name`` of a declaration in tokens a to b, or null: a type followed by a name."""
    i = a
    if i >= b or t.kind[i] != "id" or t.text[i] in WORDS:
        return None
    if t.text[i] == "mapping" and i + 1 < b and t.text[i + 1] == "(":
        i = t.partner[i + 1] + 1
    else:
        i += 1
        while i + 1 < b and t.text[i] == "." and t.kind[i + 1] == "id":
            i += 2
        if i < b and t.text[i] == "payable":
            i += 1
    while i < b and t.text[i] == "[" and t.partner[i] > 0:
        i = t.partner[i] + 1
    last = i
    while i < b and t.kind[i] == "id" and t.text[i] in WORDS:
        i += 1
    if i < b and t.kind[i] == "id" and t.text[i] not in WORDS and (i + 1 >= b or t.text[i + 1] in {"=", ";", ",", ")"}):
        return " ".join(t.text[a:last]).replace(" [ ", "[").replace(" ]", "]").replace(" . ", "."), t.text[i]
    return None


def parse_contracts(src: str) -> list[dict]:
    """Contracts, interfaces and libraries with bases, state variables and functions, in order."""
    t, out, i, n = scan(src), [], 0, 0
    n = len(t.text)
    while i < n:
        if t.text[i] in {"contract", "interface", "library"} and i + 1 < n and t.kind[i + 1] == "id":
            kind, name, j, bases = t.text[i], t.text[i + 1], i + 2, []
            while j < n and t.text[j] != "{":
                if t.kind[j] == "id" and t.text[j] != "is" and t.text[j - 1] in {"is", ","}:
                    bases.append(t.text[j])
                j = t.partner[j] + 1 if t.text[j] == "(" and t.partner[j] > j else j + 1
            if j >= n:
                break
            close = t.partner[j]
            state, types, functions, k = [], {}, [], j + 1
            while k < close:
                if t.text[k] in {"function", "constructor", "modifier", "fallback", "receive"}:
                    body = k
                    while body < close and t.text[body] not in {"{", ";"}:
                        body = t.partner[body] + 1 if t.text[body] == "(" and t.partner[body] > body else body + 1
                    stop = t.partner[body] if body < close and t.text[body] == "{" else min(body, close)
                    if t.text[k] == "function" and k + 1 < close and t.kind[k + 1] == "id":
                        functions.append({"name": t.text[k + 1], "start": t.start[k], "end": t.end[min(stop, n - 1)], "has_body": body < close and t.text[body] == "{"})
                    k = stop + 1
                elif t.text[k] in {"struct", "enum"}:
                    while k < close and t.text[k] != "{":
                        k += 1
                    k = (t.partner[k] if k < close else k) + 1
                else:
                    stop = k
                    while stop < close and t.text[stop] != ";":
                        stop = t.partner[stop] + 1 if t.text[stop] in OPEN and t.partner[stop] > stop else stop + 1
                    got = _declared(t, k, stop + 1)
                    if got and got[1] not in types:
                        state.append(got[1])
                        types[got[1]] = got[0]
                    k = stop + 1
            out.append({"kind": kind, "name": name, "bases": bases, "state_vars": state, "types": types, "functions": functions})
            i = close + 1
        else:
            i += 1
    return out


def local_types(t: Tokens) -> dict[str, str]:
    """C4: parameters and declared variables of a function with their types."""
    out: dict[str, str] = {}
    for i in range(len(t.text)):
        if i == 0 or t.text[i - 1] in {"(", ",", ";", "{", "}"} or t.text[i - 1] == ")":
            # a type never follows a member access, a call argument list never has two names in a row
            got = _declared(t, i, len(t.text))
            if got:
                out.setdefault(got[1], got[0])
    return out


def member_calls(t: Tokens, src: str) -> list[dict]:
    """Calls of a member, in document order of their receivers: text, method, receiver root.

    Members of built-in globals (``abi.encode``) are no calls that leave the contract; ``this`` and
    the addresses of ``msg`` and ``tx`` are.
    """
    out = []
    for i in range(1, len(t.text) - 1):
        if t.text[i] != "." or t.kind[i + 1] != "id":
            continue
        j = i + 2
        if j < len(t.text) and t.text[j] == "{":
            j = t.partner[j] + 1
        if j >= len(t.text) or t.text[j] != "(":
            continue
        k, cast = i - 1, t.text[i - 1] == ")"
        while k >= 0:
            if t.text[k] in {")", "]"} and t.partner[k] >= 0:
                k = t.partner[k] - 1
                if k >= 0 and t.kind[k] != "id" and t.text[k] not in {")", "]"}:
                    k += 1
                    break
            elif t.kind[k] == "id" and k > 0 and t.text[k - 1] == ".":
                k -= 2
            else:
                break
        root = t.text[k] if k >= 0 and t.kind[k] == "id" else None
        k = max(k, 0)
        if root in BUILTIN_GLOBALS and root not in {"this", "msg", "tx"}:
            continue
        out.append({
            "at": k, "order": i, "call_text": src[t.start[k] : t.end[t.partner[j]]][:120], "method": t.text[i + 1],
            "receiver": root, "is_cast": bool(cast and root is not None),
        })
    return sorted(out, key=lambda c: (c["at"], -c["order"]))


def accesses(t: Tokens, names: set[str], locals_: dict[str, str]) -> list[tuple[int, str]]:
    """Position and name of each identifier that is one of ``names``."""
    return [
        (i, x) for i, (x, k) in enumerate(zip(t.text, t.kind))
        if k == "id" and x in names and x not in locals_ and x not in BUILTIN_GLOBALS and (i == 0 or t.text[i - 1] != "emit")
    ]


def _is_write(t: Tokens, i: int) -> bool:
    if (i + 1 < len(t.text) and t.text[i + 1] in {"++", "--"}) or (i and t.text[i - 1] in {"++", "--"}):
        return True
    j = i + 1
    while j < len(t.text) and t.text[j] not in {";", "{", "}"}:
        if t.text[j] in ASSIGN:
            return True
        if t.text[j] == "(" and t.partner[j] > j:
            j = t.partner[j]
        elif t.text[j] == ")" and 0 <= t.partner[j] < i:
            # leaving a call or tuple: what follows may still assign to the tuple
            pass
        elif t.text[j] in {"==", "!=", "<=", ">=", "&&", "||", ",", "<", ">", "?", "+", "-", "*", "/"} and j > i:
            # within round brackets that reach further, as of a tuple, an assignment may still follow
            p = t.outer[i]
            while p >= 0 and not (t.text[p] == "(" and t.partner[p] > j):
                p = t.outer[p]
            if p < 0:
                return False
        j += 1
    return False


def events(t: Tokens, src: str, names: set[str], locals_: dict[str, str]) -> list[tuple[str, str]]:
    """Reads, writes and member calls in document order."""
    got = [(c["at"], 0, "call", c["call_text"][:50]) for c in member_calls(t, src)]
    got += [(i, 1, "write" if _is_write(t, i) else "read", x) for i, x in accesses(t, names, locals_)]
    return [(kind, name) for _, _, kind, name in sorted(got, key=lambda e: (e[0], e[1]))]


_VARIABLE = re.compile(
    # fixed values: a type, what may stand between, and the name before a semicolon or an assignment
    r"(?:mapping|uint\d*|int\d*|address|bool|bytes\d*|string|I[A-Z]\w+|[A-Z]\w+)\b(?:\s*\([^)]*\))?(?:\s*\[\])*"
    r"(?:\s+(?:public|private|internal|external|constant|immutable|override|payable))*\s+(\w+)\s*[;=]"
)
# How lines begin that declare no variable, and how headers of bodies end.
_NO_VARIABLE = (
    "event ", "error ", "modifier ", "function ", "using ", "import ", "struct ", "enum ", "constructor", "receive()",
    "fallback()", "pragma ", "interface ", "library ", "abstract ", "//", "*", "/*",
)
_NO_NAMES = {
    "returns", "return", "if", "else", "for", "while", "do", "require", "emit", "new", "delete", "memory", "storage",
    "calldata", "override", "virtual",
}


_INNER = re.compile(r"[^\n{}]*\{[^{}]*\}")


def contract_variables(src: str) -> set[str]:
    """Variables declared on lines of the first contract that lie in no inner braces, by expressions.

    Inner braces are taken out from the innermost on, with what stands before them in their line.
    """
    opening = re.search(r"contract\s+\w+[^{]*\{", src or "")
    body, found = (src[opening.end():], 1) if opening else ("", 0)
    while found:
        body, found = _INNER.subn("\n", body)
    lines = re.split(r"[{}]", body, maxsplit=1)[0].split("\n")[:-1]  # a line that a brace ends declares nothing
    declared = (_VARIABLE.search(x) for x in map(str.strip, lines) if x and not x.startswith(_NO_VARIABLE))
    return {m.group(1) for m in declared if m} - _NO_NAMES


def extract_function(src: str, name: str) -> str | None:
    """C14: the first function of that name with its body, by matching braces."""
    t = scan(src)
    for i in range(len(t.text) - 1):
        if t.text[i] == "function" and t.text[i + 1] == name:
            j = i
            while j < len(t.text) and t.text[j] not in {"{", ";"}:
                j += 1
            if j < len(t.text) and t.text[j] == "{":
                return src[t.start[i] : t.end[t.partner[j]]]
    return None


CONTRACT_SCHEMA = """bundle string, file string, ord int, name string, kind string, bases array<string>,
    state_vars array<string>, types map<string,string>, functions array<struct<name:string,start:int,end:int,has_body:boolean>>"""


def contracts_of(sources: DataFrame, bundle: str = "bundle", file: str = "file", text: str = "text") -> DataFrame:
    """C3 over a table: one row a contract; every source is parsed once. Null texts give none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for b, f, src in zip(pdf[bundle], pdf[file], pdf[text]):
                for i, c in enumerate(parse_contracts(src) if src else []):
                    rows.append((b, f, i, c["name"], c["kind"], c["bases"], c["state_vars"], c["types"], c["functions"]))
            yield pd.DataFrame(rows, columns=["bundle", "file", "ord", "name", "kind", "bases", "state_vars", "types", "functions"])

    return sources.select(bundle, file, text).mapInPandas(run, CONTRACT_SCHEMA)


FUNCTION_SCHEMA = """locals map<string,string>, identifiers array<string>,
    calls array<struct<call_text:string,method:string,receiver:string,is_cast:boolean>>,
    events array<struct<kind:string,name:string>>, parsed boolean"""


def functions_of(df: DataFrame, id_col: str, text: str, state_vars: str) -> DataFrame:
    """C4-C6, C10, C13 over a table of single functions: one row a row, nulls for a null text.

    ``state_vars`` is an array of the names visible to the function; ``identifiers`` comes out as
    the sorted distinct ones that it uses.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, src, names in zip(pdf[id_col], pdf[text], pdf[state_vars]):
                if src is None:
                    rows.append((key, None, None, None, None, None))
                    continue
                t = scan(src)
                loc, known = local_types(t), set(names) if names is not None else set()
                rows.append((
                    key, loc, sorted({x for _, x in accesses(t, known, loc)}),
                    [{k: c[k] for k in ("call_text", "method", "receiver", "is_cast")} for c in member_calls(t, src)],
                    [{"kind": a, "name": b} for a, b in events(t, src, known, loc)],
                    t.matched and "function" in t.text,
                ))
            yield pd.DataFrame(rows, columns=[id_col, "locals", "identifiers", "calls", "events", "parsed"])

    return df.select(id_col, text, state_vars).mapInPandas(run, f"`{id_col}` {kind}, {FUNCTION_SCHEMA}")


def bodies_of(df: DataFrame, id_col: str, text: str, name: str) -> DataFrame:
    """C14 over a table: ``<id_col>, body``: the function of that name with its body, null if there is none."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [extract_function(src, n) if src and n else None for src, n in zip(pdf[text], pdf[name])]
            yield pd.DataFrame({id_col: pdf[id_col], "body": pd.Series(found, dtype=object)})

    return df.select(id_col, text, name).mapInPandas(run, f"`{id_col}` {kind}, body string")


def variables_of(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """C16 over a table: ``<id_col>, variables``, sorted; empty for a null text."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({id_col: pdf[id_col], "variables": [sorted(contract_variables(s)) if s else [] for s in pdf[text]]})

    return df.select(id_col, text).mapInPandas(run, f"`{id_col}` {kind}, variables array<string>")
