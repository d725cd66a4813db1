"""Rule tables and classifiers over text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Vulnerability types and, in order, the words in a text that give them. The first
# rule that matches wins; without any match the type is the first one.
VTYPES = {
    "Reentrancy (SWC-107)": ["reentrancy", "re-entrancy", "reentrant", "callback"],
    "Unchecked Call Return (SWC-104)": ["unchecked", "call return"],
    "Front-running / Tx Order (SWC-114)": ["front-run", "frontrun", "sandwich", "transaction order"],
    "Delegatecall (SWC-112)": ["delegatecall"],
}
DEFAULT_VTYPE = next(iter(VTYPES))


def first_rule(text: Column, rules: dict[str, list[str]], default: str | None) -> Column:
    """The name of the first rule one of whose words ``text`` contains, as one CASE expression."""
    out = F.lit(default)
    for name, words in reversed(rules.items()):
        hit = F.lit(False)
        for word in words:
            hit = hit | text.contains(word)
        out = F.when(hit, F.lit(name)).otherwise(out)
    return out


def vulnerability_type(title: Column, description: Column | None = None) -> Column:
    """The type that title and description give; null parts count as empty."""
    text = F.coalesce(title, F.lit(""))
    if description is not None:
        text = F.concat(text, F.lit(" "), F.coalesce(description, F.lit("")))
    return first_rule(F.lower(text), VTYPES, DEFAULT_VTYPE)


# Roots of the interaction weaknesses and their descendants.
INTERACTION_CWES = [
    "CWE-1265", "CWE-841", "CWE-691", "CWE-362", "CWE-435", "CWE-670", "CWE-696", "CWE-835",
    "CWE-674", "CWE-834", "CWE-364", "CWE-366", "CWE-367", "CWE-421", "CWE-436", "CWE-437",
    "CWE-439", "CWE-662", "CWE-663", "CWE-667", "CWE-764", "CWE-765", "CWE-820", "CWE-821",
    "CWE-1058", "CWE-1088",
]
# Interaction keywords, without regard to case.
INTERACTION_KEYWORDS = [
    r"re-?entrancy", r"re-?entrant", r"flash[\s-]?loan", r"front[\s-]?run(?:ning)?", r"sandwich",
    r"cross[\s-]?contract", r"callback", r"read[\s-]?only[\s-]?re-?entrancy", r"reentrancy",
]
# Codes of interaction findings.
INTERACTION_SWCS = ["SWC-107", "SWC-114", "SWC-104", "SWC-112"]
# Method sets of call classification.
LOW_LEVEL = ["call", "delegatecall", "staticcall", "transfer", "send"]
SAFE_TRANSFER = ["safeTransfer", "safeTransferFrom", "safeApprove", "safeIncreaseAllowance", "safeDecreaseAllowance"]
ERC_LIKE = ["transfer", "transferFrom", "approve", "balanceOf", "allowance", "mint", "burn", "burnFrom"]
DEFI = [
    "deposit", "withdraw", "borrow", "repay", "liquidate", "flashLoan", "execute", "unlock", "lock",
    "settle", "take", "getSlot0", "accrueInterest", "flash", "claim",
]
ORACLE = ["getPrice", "latestAnswer", "latestRoundData"]
OTHER_EXTERNAL = [
    "swap", "swapExactTokensForTokens", "swapExactTokensForTokensSupportingFeeOnTransferTokens",
    "swapTokensForExactTokens", "swapExactETHForTokens", "swapExactTokensForETH", "addLiquidity",
    "removeLiquidity", "getAmountsOut", "getAmountsIn", "exactInputSingle", "exactInput",
    "exactOutputSingle", "exactOutput",
]
BUILTIN_GLOBALS = [
    "msg", "block", "tx", "abi", "type", "super", "this", "now", "gasleft", "blockhash", "keccak256",
    "sha256", "ripemd160", "ecrecover", "addmod", "mulmod", "selfdestruct", "assert", "require",
    "revert", "emit",
]
# Methods that only read.
READ_ONLY = [
    "balanceOf", "allowance", "totalSupply", "decimals", "symbol", "name", "getPrice", "latestAnswer",
    "latestRoundData", "latestRound", "getRoundData", "getLatestPrice", "getPricePerFullShare",
    "get_virtual_price", "virtualPrice", "getSharesByPooledEth", "getPooledEthByShares", "getReserves",
    "getAmountsOut", "getAmountsIn", "getLUSDDebt", "getEntireSystemDebt", "getCollateral", "getDebt",
    "slot0", "positions", "computeAddress", "mul", "div", "add", "sub", "mod",
]
# Methods that only read, as the review of labels has them (M15), a shorter list than that of M17.
REVIEW_READ_ONLY = [
    "balanceOf", "allowance", "getPrice", "latestAnswer", "latestRoundData", "getPricePerFullShare",
    "get_virtual_price", "getSharesByPooledEth", "getPooledEthByShares", "getLUSDDebt", "totalSupply",
    "decimals", "symbol", "name", "slot0", "positions", "computeAddress", "mul", "div", "add", "sub",
]
# Words in a receiver's name that make a call external where nothing else does, and
# members that are none.
FALLBACK_WORDS = [
    "token", "vault", "pool", "oracle", "router", "manager", "registry", "factory", "strategy", "game",
    "governor", "bridge", "escrow", "wallet", "aggregator",
]
BUILTIN_MEMBERS = ["length", "push", "pop", "selector", "balance", "code", "codehash"]
# Methods that move value.
VALUE_TRANSFER = ["transfer", "transferFrom", "approve", "safeTransfer", "safeTransferFrom", "safeApprove", "sendETH", "returnData"]


def category_codes(category: Column) -> Column:
    """All codes of a map of levels to code lists."""
    return F.flatten(F.map_values(category))


def has_interaction_cwe(category: Column) -> Column:
    """P1."""
    return F.coalesce(F.arrays_overlap(category_codes(category), F.array(*map(F.lit, INTERACTION_CWES))), F.lit(False))


def finding_text(title: Column, description: Column) -> Column:
    return F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(description, F.lit("")))


def has_interaction_keyword(title: Column, description: Column) -> Column:
    """P2."""
    return finding_text(title, description).rlike("(?i)" + "|".join(INTERACTION_KEYWORDS))


def match_type(by_cwe: Column, by_keyword: Column) -> Column:
    """Both, cwe-only, keyword-only, or null for no match."""
    return (
        F.when(by_cwe & by_keyword, "both").when(by_cwe, "cwe-only").when(by_keyword, "keyword-only")
    )


def swc_of(code: Column, vtype: Column, category: Column) -> Column:
    """The code, or else what vtype or category holds."""
    text = F.coalesce(F.nullif(vtype, F.lit("")), category, F.lit(""))
    derived = F.lit("")
    for number in ("112", "114", "107", "104"):
        derived = F.when(text.contains(number), F.lit(f"SWC-{number}")).otherwise(derived)
    return F.coalesce(F.nullif(code, F.lit("")), derived)


def first_filled(*columns: Column) -> Column:
    """P10: the first value that is neither null nor empty, else empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns], F.lit(""))


def is_contract_type(type_name: Column, known: Column | None = None) -> Column:
    """Whether a type names a contract; mappings count by their value, arrays by their element."""
    base = F.trim(F.regexp_replace(F.regexp_replace(type_name, r"(?s)\A.*=>", ""), r"\)+\s*\z", ""))
    base = F.trim(F.regexp_replace(base, r"[\[\]]+\z", ""))
    primitive = base.rlike(r"\A(?:address|bool|string|var|byte)\z|\A(?:uint|int|bytes|ufixed|fixed)")
    hit = base.rlike(r"\A[A-Z]|\A(?:ERC20|ERC721|ERC1155|IERC|SafeERC)")
    if known is not None:
        hit = hit | F.array_contains(known, base)
    return F.coalesce(~primitive & hit, F.lit(False))


def classify_call(
    method: Column, receiver: Column, receiver_type: Column, scope: Column, is_cast: Column, known: Column | None = None,
    fallback: bool = False, chain: Column | None = None,
) -> Column:
    """The kind of a member call, null for one that leaves the contract in no way.

    ``receiver_type`` is the declared type of the receiver and ``scope`` where it is declared
    (``state`` or ``local``), both null for other names. Rules apply in order. With ``fallback`` (C8) a
    word in the receiver's name, or in the text ``chain`` of a receiver of several members, decides last.
    """
    globals_ = receiver.isin(BUILTIN_GLOBALS) & (receiver != "this")
    named_type = receiver.rlike(r"\AI[A-Z]")
    if known is not None:
        named_type = named_type | F.array_contains(known, receiver)
    return (
        F.when(globals_ & receiver.isin("msg", "tx") & method.isin(LOW_LEVEL), "low-level")
        .when(globals_, None)
        .when(method.isin(LOW_LEVEL), "low-level")
        .when(method.isin(SAFE_TRANSFER), "safe-transfer")
        .when(is_contract_type(receiver_type, known) & (scope == "state"), "state-var")
        .when(is_contract_type(receiver_type, known) & (scope == "local"), "local-var")
        .when(is_contract_type(receiver, known) & is_cast, "cast")
        .when(is_contract_type(receiver, known) & named_type, "contract-name")
        .when(receiver.isNull() | (receiver == "this"), None)
        .when(method.isin(ERC_LIKE), "erc-like").when(method.isin(DEFI), "defi")
        .when(method.isin(ORACLE), "oracle").when(method.isin(OTHER_EXTERNAL), "other")
        .when(F.lit(fallback) & _by_word(method, receiver, chain), "fallback")
    )


def _by_word(method: Column, receiver: Column, chain: Column | None) -> Column:
    """A receiver that does not begin with a capital, or a chain of members, with one of the words."""
    words = "|".join(FALLBACK_WORDS)
    hit = ~receiver.rlike(r"\A\p{Lu}") & F.lower(receiver).rlike(words) & ~receiver.isin(BUILTIN_GLOBALS)
    if chain is not None:
        hit = hit | (chain.contains(".") & F.lower(chain).rlike(words))
    return F.coalesce(hit & ~method.isin(BUILTIN_MEMBERS), F.lit(False))


def type_of_call(kind: Column, receiver: Column, receiver_type: Column) -> Column:
    """The contract type a call of this kind goes to: the declared type, or the receiver's own name; null
    for calls that are told by their method."""
    return F.when(kind.isin("state-var", "local-var"), receiver_type).when(kind.isin("cast", "contract-name"), receiver)


def is_cross_contract(types: Column, contracts: Column, own: Column) -> Column:
    """C11: whether any call goes to a contract of the bundle other than its own; ``types`` are those of
    ``type_of_call``, ``contracts`` the names in the bundle."""
    bare = F.transform(types, lambda t: F.trim(F.regexp_replace(t, r"[\[\]]+\z", "")))
    return F.coalesce(F.exists(bare, lambda t: t.isNotNull() & F.array_contains(contracts, t) & (t != own)), F.lit(False))


def leaves_contract(receivers: Column, own: Column, bases: Column) -> Column:
    """C12, the test of the review: whether any call's receiver is neither the contract, ``this`` nor a direct
    base. A receiver that has no name counts as one of the contract."""
    return F.coalesce(F.exists(receivers, lambda r: r.isNotNull() & (r != own) & (r != "this") & ~F.array_contains(bases, r)), F.lit(False))


def label_of(is_positive: Column) -> Column:
    """1 for a positive, else 0; null counts as no positive."""
    return F.coalesce(is_positive.cast("int"), F.lit(0))


def label_is_invalid(code: Column, view_or_pure: Column, methods: Column) -> Column:
    """An unchecked-return label on a view or pure function all of whose calls only read.

    Emitted as a proposal; no label is changed. A function without calls only reads.
    """
    return code.contains("104") & view_or_pure & F.forall(methods, lambda m: m.isin(READ_ONLY))


def label_quality(code: Column, category: Column, src: Column, methods: Column, calls: Column, state_vars: Column, writes: Column) -> Column:
    """A struct ``quality, reason`` by ordered rules for each code, or what the category says.

    ``methods`` and ``calls`` are the methods and texts of the external calls, ``writes`` whether the source
    assigns to a state variable (C20). Null code and category count as empty.
    """
    code, category = F.coalesce(code, F.lit("")), F.lower(F.coalesce(category, F.lit("")))
    is_ = lambda number, *words: code.contains(number) | F.greatest(*[category.contains(w) for w in words], F.lit(False))
    any_of = lambda names: F.exists(methods, lambda m: m.isin(names))
    delegates = F.exists(methods, lambda m: m.contains("delegatecall")) | F.exists(calls, lambda c: c.contains("delegatecall"))
    only_reads = F.forall(methods, lambda m: m.isin(REVIEW_READ_ONLY))
    head = F.substring_index(src, "{", 1)
    say = lambda quality, reason: F.struct(F.lit(quality).alias("quality"), F.lit(reason).alias("reason"))
    unchecked = (
        F.when(any_of(LOW_LEVEL), say("CONFIRMED", "low-level call"))
        .when(any_of(VALUE_TRANSFER), say("CONFIRMED", "value transfer"))
        .when((head.contains("view") | head.contains("pure")) & only_reads, say("DUBIOUS", "view that only reads"))
        .when(only_reads, say("DUBIOUS", "only reads"))
        .otherwise(say("CONFIRMED", "external call"))
    )
    return (
        F.when(src.isNull(), say("COMMIT_DRIFT", "no source"))
        .when(F.size(methods) == 0, say("DUBIOUS", "no call")).when(F.size(state_vars) == 0, say("DUBIOUS", "no state"))
        .when(is_("107", "reentrancy") & writes, say("CONFIRMED", "call and write"))
        .when(is_("107", "reentrancy"), say("CONFIRMED", "call and access"))
        .when(is_("112", "delegatecall") & delegates, say("CONFIRMED", "delegatecall"))
        .when(is_("112", "delegatecall") & src.contains("delegatecall"), say("CONFIRMED", "delegatecall in the text"))
        .when(is_("112", "delegatecall"), say("MISLOCATED", "no delegatecall"))
        .when(is_("104", "unchecked"), unchecked)
        .when(is_("114", "front", "transaction order"), say("CONFIRMED", "call that depends on state"))
        .otherwise(say("CONFIRMED", "constructable"))
    )
