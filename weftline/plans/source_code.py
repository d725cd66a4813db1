"""Source texts: calls, events, variants and label rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import rules, solidity, text
from weftline.operators import augment
from weftline.plans.keys import hashed_examples
from weftline.plans.registry import query, table

# The SQL has its own statement of the fixed values, so that a slip in the rules shows.
_LIST = lambda words: ", ".join(f"'{x}'" for x in words.split())
_READS = _LIST(
    "add allowance balanceOf computeAddress decimals div get_virtual_price getAmountsIn getAmountsOut getCollateral getDebt getEntireSystemDebt getLUSDDebt getLatestPrice "
    "getPooledEthByShares getPrice getPricePerFullShare getReserves getRoundData getSharesByPooledEth latestAnswer latestRound latestRoundData mod mul name positions slot0 sub symbol "
    "totalSupply virtualPrice"
)
_LOW = _LIST("call delegatecall send staticcall transfer")
_SAFE = _LIST("safeApprove safeDecreaseAllowance safeIncreaseAllowance safeTransfer safeTransferFrom")
_GLOBALS = _LIST("abi addmod assert block blockhash ecrecover emit gasleft keccak256 msg mulmod now require revert ripemd160 selfdestruct sha256 super tx type")
_TOKENS = _LIST("allowance approve balanceOf burn burnFrom mint transfer transferFrom")
_FINANCE = _LIST("accrueInterest borrow claim deposit execute flash flashLoan getSlot0 liquidate lock repay settle take unlock withdraw")
_PRICES = _LIST("getPrice latestAnswer latestRoundData")
_OTHERS = _LIST(
    "addLiquidity exactInput exactInputSingle exactOutput exactOutputSingle getAmountsIn getAmountsOut removeLiquidity swap swapExactETHForTokens swapExactTokensForETH "
    "swapExactTokensForTokens swapExactTokensForTokensSupportingFeeOnTransferTokens swapTokensForExactTokens"
)
_CALLS = "|".join(text.CALL_PATTERNS)


def _examples(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "forge_hyperedge_examples")


@query(r"""WITH c AS (SELECT example_id, array_to_string(list_filter(list_transform(string_split_regex(regexp_replace(regexp_replace(function_source, '//[^\n]*', '', 'g'), '/\*.*?\*/', '', 'gs'), '\r\n|[\n\r]'),
  lambda l: trim(regexp_replace(l, '[\s\x0b\x{85}\p{Z}]+', ' ', 'g'))), lambda l: l <> ''), E'\n') AS cleaned FROM forge_hyperedge_examples),
a AS (SELECT example_id, cleaned, CASE WHEN regexp_matches(cleaned, '\b0x0\b') THEN regexp_replace(cleaned, '\b0x0\b', 'address(0)', 'g') ELSE replace(cleaned, 'address(0)', '0x0') END AS s FROM c)
SELECT example_id, cleaned, CASE WHEN regexp_matches(s, '\buint\b') THEN regexp_replace(s, '\buint\b', 'uint256', 'g') ELSE regexp_replace(s, '\buint256\b', 'uint', 'g') END AS swapped FROM a""")
def h01_text_transforms(spark: SparkSession, sf: str) -> DataFrame:
    """F4, F5, T2, T3."""
    cleaned = _examples(spark, sf).select("example_id", text.clean_comments(F.col("function_source")).alias("cleaned"))
    return cleaned.withColumn("swapped", text.swap_literals(F.col("cleaned")))


def _items(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Training examples, and the hashes of the evaluation splits."""
    items = _examples(spark, sf).where("function_source is not null").join(
        table(spark, sf, "split_items").select("hyperedge_id", F.lower(F.trim("split")).alias("split"), "label"), "hyperedge_id"
    )
    held = items.where("split in ('val', 'test')").select(text.source_hash(F.col("function_source")).alias("hash"))
    # receivers of the calls on record count as state variables of a contract type
    call = F.filter("external_calls", lambda c: ~c.rlike(r"\A\s*[A-Za-z_$][\w$]*\s*\("))
    receivers = F.filter(F.array_distinct(F.transform(call, text.call_receiver)), lambda r: r != "")
    types = F.map_from_arrays(receivers, F.transform(receivers, lambda r: F.concat(F.lit("I"), F.initcap(r))))
    return items.where("split = 'train'").withColumn("types", types), held


@query(None)
def h02_reject_cascade(spark: SparkSession, sf: str) -> DataFrame:
    """The variants of every training example, verified, with where they come from; a null reason means accepted."""
    train, held = _items(spark, sf)
    tried = augment.variants(train, "example_id", "function_source", "label", "state_vars_accessed", "types")
    own = train.select(
        "example_id", text.source_hash(F.col("function_source")).alias("own_hash"), text.stem(F.trim("file")).alias("contract"),
        augment.source_id(F.trim("vfp_id"), id_=F.col("example_id")).alias("source_id"),
    )
    reasons = augment.verify(tried, "example_id", own.drop("source_id"), held, "contract")
    return reasons.join(own.select("example_id", "source_id"), "example_id").withColumn(
        "transforms_applied", F.array(F.concat(F.lit("transform_"), F.col("variant").cast("string")))
    )


@query("""SELECT example_id, unnest(range(1, CASE WHEN label = 1 THEN 6 ELSE 3 END)) AS variant, coalesce(nullif(trim(vfp_id), ''), 'train_' || example_id) AS source_id
FROM forge_hyperedge_examples JOIN split_items USING (hyperedge_id) WHERE function_source IS NOT NULL AND lower(trim(split)) = 'train'""")
def h04_fan_out(spark: SparkSession, sf: str) -> DataFrame:
    """Which variants are made of which examples, by label, and their source."""
    train, _ = _items(spark, sf)
    made = augment.variants(train, "example_id", "function_source", "label", "state_vars_accessed").select("example_id", F.col("variant").cast("bigint").alias("variant"))
    return made.join(train.select("example_id", augment.source_id(F.trim("vfp_id"), id_=F.col("example_id")).alias("source_id")), "example_id")


@query("""SELECT * FROM (VALUES (1, 1, 'sequence_order_changed'), (1, 2, NULL), (2, 1, 'not_constructable'), (2, 2, 'not_constructable'), (3, 1, 'duplicate_variant'), (3, 2, 'parse_failure'),
  (4, 1, 'duplicate_variant'), (4, 2, NULL), (5, 1, NULL), (5, 2, NULL), (5, 3, NULL), (5, 4, NULL), (5, 5, NULL), (6, 1, 'duplicate_variant'), (6, 2, 'eval_leakage_collision')) t(id, variant, reason)""")
def h05_worked_variants(spark: SparkSession, sf: str) -> DataFrame:
    """T1-T7 on hand-worked sources: an argument renamed within a call's text (1), no call (2), brackets that never close
    (3), nothing to rename or swap (4), a positive with locals in no call (5), a hash of an evaluation split (6)."""
    rows = [
        (1, "function f(uint a) external { token.go(a); total = a; }", 0), (2, "function f(uint a) external { total = a; }", 0), (3, "function f( { broken", 0),
        (4, "function g() external { token.go(); total = 1; }", 0), (5, "function h(uint a) external { uint b = a; token.go(); total = b; }", 1), (6, "function k() external { token.go(); total = 1; }", None),
    ]
    items = spark.createDataFrame(rows, "id int, src string, label int").withColumns({
        "vars": F.array(F.lit("token"), F.lit("total")), "types": F.create_map(F.lit("token"), F.lit("IToken")),
    })
    held = spark.createDataFrame([("functionk()external{uint256_inert_val_602=602+603;token.go();total=1;}",)], "t string").select(F.sha2("t", 256).alias("hash"))
    own = items.select("id", text.source_hash(F.col("src")).alias("own_hash"))
    return augment.verify(augment.variants(items, "id", "src", "label", "vars", "types"), "id", own, held)


# Rejections over rows of events: rows of one user in id order, the value in whole tens as the key.
_STATEFUL = """WITH t AS (SELECT user_id, event_id, CAST(floor(value / 10) AS BIGINT) AS key, CASE WHEN event_type = 'error' THEN 'error_event' END AS reason FROM events),
f AS (SELECT *, min(CASE WHEN reason IS NULL THEN event_id END) OVER (PARTITION BY user_id, key) AS first FROM t)
SELECT event_id, CASE WHEN first < event_id THEN 'duplicate_variant' ELSE reason END AS reason FROM f"""


@query(_STATEFUL)
def h03_first_accepted(spark: SparkSession, sf: str) -> DataFrame:
    """Accepted rows use up their key, rejected ones do not."""
    t = table(spark, sf, "events").select(
        "user_id", "event_id", F.floor(F.col("value") / 10).alias("key"), F.when(F.col("event_type") == "error", "error_event").alias("reason")
    )
    return augment.first_accepted(t, "user_id", "event_id", "key").select("event_id", "reason")


@query("""SELECT user_id, list(event_type || ':' || event_id ORDER BY ts, event_id) AS seq FROM events GROUP BY 1""")
def i01_event_sequence(spark: SparkSession, sf: str) -> DataFrame:
    """The ordered events of each user."""
    seq = F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type")))
    return table(spark, sf, "events").groupBy("user_id").agg(seq.alias("s")).select(
        "user_id", F.transform("s", lambda e: F.concat(e["event_type"], F.lit(":"), e["event_id"].cast("string"))).alias("seq")
    )


@query(rf"""WITH h AS (SELECT example_id, function_source AS src, regexp_extract_all(function_source, '(?i){_CALLS}') AS hits, regexp_split_to_array(function_source, '(?i){_CALLS}') AS gaps FROM forge_hyperedge_examples),
p AS (SELECT *, list_transform(range(1, len(hits) + 1), lambda i: list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i-1], lambda x: length(x))), 0)) AS starts FROM h),
c AS (SELECT *, list_transform(range(1, len(hits) + 1), lambda i: src[greatest(starts[i] - 40, 0)::BIGINT + 1 : (starts[i] + length(hits[i]) + 20)::BIGINT]) AS cut FROM p)
SELECT example_id, len(hits) AS n_calls, hits[1] AS first_call,
  array_to_string(list_transform(cut, lambda x: regexp_replace(regexp_replace(x, '^[\s\x0b\x{{85}}\p{{Z}}]+|[\s\x0b\x{{85}}\p{{Z}}]+$', '', 'g'), '[\s\x0b\x{{85}}\p{{Z}}]+', ' ', 'g')), ' | ') AS contexts FROM c""")
def i02_call_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Calls with what stands around them."""
    # the scan stands in a projection of its own, so that it runs once a row
    scanned = _examples(spark, sf).select("example_id", "function_source", text.scan_calls(F.col("function_source")).alias("calls"))
    return scanned.select(
        "example_id", F.when(F.col("calls").isNotNull(), F.size("calls")).cast("bigint").alias("n_calls"), F.get("calls", F.lit(0)).alias("first_call"),
        F.array_join(text.with_context(F.col("function_source"), F.col("calls")), " | ").alias("contexts"),
    )


@query(r"""SELECT example_id, list_sort(list_filter(list_distinct(state_vars_accessed), lambda v: regexp_matches(function_source, '(^|[^A-Za-z0-9_])' || v || '($|[^A-Za-z0-9_])'))) AS vars FROM forge_hyperedge_examples WHERE function_source IS NOT NULL AND state_vars_accessed IS NOT NULL""")
def i03_word_occurrence(spark: SparkSession, sf: str) -> DataFrame:
    """C17: which of a hyperedge's variables stand in its source as whole words."""
    df = _examples(spark, sf).where("function_source is not null and state_vars_accessed is not null")
    found = F.filter(F.array_distinct("state_vars_accessed"), lambda v: text.has_word(F.col("function_source"), v))
    return df.select("example_id", F.array_sort(found).alias("vars"))


_METHOD = r"regexp_extract({c}, '\.(\w+)\s*(?:\{{[^}}]*\}})?\s*\(', 1)"
_LABELS = rf"""WITH m AS (SELECT e.example_id, e.function_source AS src, s.vtype, state_vars_accessed AS sv, external_calls AS ec, list_transform(external_calls, lambda c: {_METHOD.format(c="c")}) AS m,
  coalesce(regexp_matches(string_split(lower(function_source), '{{')[1], '\b(view|pure)\b'), false) AS vp
  FROM forge_hyperedge_examples e JOIN split_items s USING (hyperedge_id))"""


def _labelled(spark: SparkSession, sf: str) -> DataFrame:
    methods = F.transform("external_calls", text.call_method)
    return _examples(spark, sf).join(table(spark, sf, "split_items", "hyperedge_id", "vtype"), "hyperedge_id").select(
        "example_id", F.col("function_source").alias("src"), "vtype", F.col("state_vars_accessed").alias("sv"),
        F.col("external_calls").alias("ec"), methods.alias("m"), text.is_view_or_pure(F.col("function_source")).alias("vp"),
    )


@query(_LABELS + f""" SELECT example_id, vp, contains(vtype, '104') AND vp AND len(list_filter(m, lambda x: x NOT IN ({_READS}))) = 0 AS invalid FROM m""")
def i04_label_rule(spark: SparkSession, sf: str) -> DataFrame:
    """Proposals to withdraw a label; nothing is relabelled."""
    return _labelled(spark, sf).select("example_id", "vp", rules.label_is_invalid(F.col("vtype"), F.col("vp"), F.col("m")).alias("invalid"))


@query(_LABELS + r""", w AS (SELECT *, len(list_filter(sv, lambda v: regexp_matches(src, '\b' || v || '\b\s*[\[.]?[^\n]*\s*[+\-*/]?='))) > 0 AS writes,
  coalesce(vtype, '') AS code, lower(coalesce(vtype, '')) AS cat, string_split(src, '{')[1] AS head,
  len(list_filter(m, lambda x: x NOT IN ('balanceOf', 'allowance', 'getPrice', 'latestAnswer', 'latestRoundData', 'getPricePerFullShare', 'get_virtual_price', 'getSharesByPooledEth',
    'getPooledEthByShares', 'getLUSDDebt', 'totalSupply', 'decimals', 'symbol', 'name', 'slot0', 'positions', 'computeAddress', 'mul', 'div', 'add', 'sub'))) = 0 AS reads FROM m),
q AS (SELECT example_id, CASE WHEN src IS NULL THEN 'COMMIT_DRIFT: no source' WHEN len(m) = 0 THEN 'DUBIOUS: no call' WHEN len(sv) = 0 THEN 'DUBIOUS: no state'
  WHEN contains(code, '107') OR contains(cat, 'reentrancy') THEN CASE WHEN writes THEN 'CONFIRMED: call and write' ELSE 'CONFIRMED: call and access' END
  WHEN contains(code, '112') OR contains(cat, 'delegatecall') THEN CASE WHEN len(list_filter(ec, lambda x: contains(x, 'delegatecall'))) > 0 THEN 'CONFIRMED: delegatecall'
    WHEN contains(src, 'delegatecall') THEN 'CONFIRMED: delegatecall in the text' ELSE 'MISLOCATED: no delegatecall' END
  WHEN contains(code, '104') OR contains(cat, 'unchecked') THEN CASE WHEN list_has_any(m, ['call', 'send', 'delegatecall', 'staticcall', 'transfer']) THEN 'CONFIRMED: low-level call'
    WHEN list_has_any(m, ['transferFrom', 'approve', 'safeTransfer', 'safeTransferFrom', 'safeApprove', 'sendETH', 'returnData']) THEN 'CONFIRMED: value transfer'
    WHEN (contains(head, 'view') OR contains(head, 'pure')) AND reads THEN 'DUBIOUS: view that only reads' WHEN reads THEN 'DUBIOUS: only reads' ELSE 'CONFIRMED: external call' END
  WHEN contains(code, '114') OR contains(cat, 'front') OR contains(cat, 'transaction order') THEN 'CONFIRMED: call that depends on state' ELSE 'CONFIRMED: constructable' END AS verdict FROM w)
SELECT example_id, verdict FROM q""")
def i05_label_quality(spark: SparkSession, sf: str) -> DataFrame:
    """The quality of every label with the rule that decided."""
    rows = _labelled(spark, sf)
    quality = rules.label_quality(F.col("vtype"), F.col("vtype"), F.col("src"), F.col("m"), F.col("ec"), F.col("sv"), text.writes_any(F.col("src"), F.col("sv")))
    return rows.select("example_id", quality.alias("q")).select("example_id", F.concat("q.quality", F.lit(": "), "q.reason").alias("verdict"))


@query("""SELECT * FROM (VALUES (1, 'DUBIOUS: view that only reads'), (2, 'CONFIRMED: external call'), (3, 'DUBIOUS: only reads'), (4, 'CONFIRMED: value transfer'),
  (5, 'CONFIRMED: low-level call'), (6, 'CONFIRMED: external call'), (7, 'MISLOCATED: no delegatecall'), (8, 'CONFIRMED: delegatecall in the text'), (9, 'CONFIRMED: call and write'),
  (10, 'CONFIRMED: call and access'), (11, 'COMMIT_DRIFT: no source'), (12, 'DUBIOUS: no call'), (13, 'DUBIOUS: no state'), (14, 'CONFIRMED: constructable'), (15, 'CONFIRMED: call that depends on state')) t(id, verdict)""")
def i05_worked_labels(spark: SparkSession, sf: str) -> DataFrame:
    """M15 on hand-worked items, among them reads that the rule M17 knows and this one does not (2, 6)."""
    view, plain = "function f() view { x; }", "function f() { x = 1; }"
    rows = [
        (1, "SWC-104", None, view, ["balanceOf"], ["x"]), (2, "SWC-104", None, plain, ["getReserves", "getAmountsOut"], ["x"]), (3, "SWC-104", None, plain, ["slot0", "mul"], ["x"]),
        (4, "SWC-104", None, plain, ["approve", "name"], ["x"]), (5, None, "Unchecked Call", plain, ["send"], ["x"]), (6, "SWC-104", None, view, ["latestRound", "getDebt", "mod"], ["x"]),
        (7, "SWC-112", None, plain, ["go"], ["x"]), (8, "SWC-112", None, "function f() { /* delegatecall */ }", ["go"], ["x"]), (9, "SWC-107", None, plain, ["go"], ["x"]),
        (10, "", "Reentrancy", view, ["go"], ["x"]), (11, "SWC-107", None, None, ["go"], ["x"]), (12, "SWC-107", None, plain, [], ["x"]), (13, "SWC-107", None, plain, ["go"], []),
        (14, None, None, plain, ["go"], ["x"]), (15, "SWC-114", None, plain, ["go"], ["x"]),
    ]
    df = spark.createDataFrame(rows, "id int, code string, category string, src string, m array<string>, sv array<string>")
    q = rules.label_quality(F.col("code"), F.col("category"), F.col("src"), F.col("m"), F.col("m"), F.col("sv"), text.writes_any(F.col("src"), F.col("sv")))
    return df.select("id", F.concat(q["quality"], F.lit(": "), q["reason"]).alias("verdict"))


@query(r"""SELECT example_id, len(list_filter(state_vars_accessed, lambda v: regexp_matches(function_source, '\b' || v || '\b\s*[\[.]?[^\n]*\s*[+\-*/]?='))) > 0 AS writes FROM forge_hyperedge_examples
WHERE function_source IS NOT NULL AND state_vars_accessed IS NOT NULL""")
def i06_state_writes(spark: SparkSession, sf: str) -> DataFrame:
    """C20."""
    df = _examples(spark, sf).where("function_source is not null and state_vars_accessed is not null")
    return df.select("example_id", text.writes_any(F.col("function_source"), F.col("state_vars_accessed")).alias("writes"))


@query(rf"""WITH c AS (SELECT hyperedge_id, unnest(external_calls) AS call FROM (SELECT DISTINCT hyperedge_id, external_calls FROM forge_constructable_hyperedges)),
p AS (SELECT call, {_METHOD.format(c="call")} AS m, regexp_extract(call, '^\s*([A-Za-z_$][\w$]*)', 1) AS r, regexp_matches(call, '^\s*[A-Za-z_$][\w$]*\s*\(.*\)\s*\.') AS casts FROM c)
SELECT CASE WHEN r IN ('msg', 'tx') AND m IN ({_LOW}) THEN 'low-level' WHEN r IN ({_GLOBALS}) THEN NULL
  WHEN m IN ({_LOW}) THEN 'low-level' WHEN m IN ({_SAFE}) THEN 'safe-transfer'
  WHEN regexp_matches(r, '^[A-Z]') AND casts THEN 'cast' WHEN regexp_matches(r, '^I[A-Z]') THEN 'contract-name' WHEN r = 'this' THEN NULL
  WHEN m IN ({_TOKENS}) THEN 'erc-like' WHEN m IN ({_FINANCE}) THEN 'defi' WHEN m IN ({_PRICES}) THEN 'oracle'
  WHEN m IN ({_OTHERS}) THEN 'other' END AS kind, count(*) AS n FROM p GROUP BY 1""")
def i07_call_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Calls of all hyperedges by kind."""
    calls = table(spark, sf, "forge_constructable_hyperedges", "hyperedge_id", "external_calls").distinct().select(F.explode("external_calls").alias("call"))
    none = F.lit(None).cast("string")
    kind = rules.classify_call(
        text.call_method(F.col("call")), text.call_receiver(F.col("call")), none, none, F.col("call").rlike(r"\A\s*[A-Za-z_$][\w$]*\s*\(.*\)\s*\.")
    )
    return calls.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@query(r"""SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9_]+|[^A-Za-z0-9_\s]')) AS n_tokens FROM documents""")
def i08_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    """F9."""
    return table(spark, sf, "documents").select("doc_id", text.word_count(F.col("text")).cast("bigint").alias("n_tokens"))


@query(r"""WITH c AS (SELECT DISTINCT hyperedge_id, unnest(external_calls) AS call FROM forge_constructable_hyperedges),
p AS (SELECT hyperedge_id, regexp_extract(call, '\.(\w+)\s*(?:\{[^}]*\})?\s*\(', 1) AS m, regexp_extract(call, '^\s*([A-Za-z_$][\w$]*)', 1) AS r FROM c)
SELECT count(*) AS n_calls, count_if(NOT regexp_matches(r, '^\p{Lu}') AND r NOT IN ('msg', 'tx', 'this', 'block', 'abi', 'type', 'super', 'now')
  AND regexp_matches(lower(r), 'token|vault|pool|oracle|router|manager|registry|factory|strategy|game|governor|bridge|escrow|wallet|aggregator')
  AND m NOT IN ('length', 'push', 'pop', 'selector', 'balance', 'code', 'codehash')
  AND m NOT IN ('call', 'delegatecall', 'staticcall', 'transfer', 'send', 'safeTransfer', 'safeTransferFrom', 'safeApprove', 'safeIncreaseAllowance', 'safeDecreaseAllowance', 'transferFrom', 'approve',
    'balanceOf', 'allowance', 'mint', 'burn', 'burnFrom', 'deposit', 'withdraw', 'borrow', 'repay', 'liquidate', 'flashLoan', 'execute', 'unlock', 'lock', 'settle', 'take', 'getSlot0', 'accrueInterest',
    'flash', 'claim', 'getPrice', 'latestAnswer', 'latestRoundData', 'swap', 'addLiquidity', 'removeLiquidity', 'getAmountsOut', 'getAmountsIn', 'exactInputSingle', 'exactInput', 'exactOutputSingle', 'exactOutput')
  AND NOT regexp_matches(m, '^swap(Exact|Tokens).*For')) AS n_fallback FROM p""")
def i09_keyword_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """How many calls only a word in the receiver's name makes external."""
    calls = table(spark, sf, "forge_constructable_hyperedges", "hyperedge_id", "external_calls").select("hyperedge_id", F.explode("external_calls").alias("call")).distinct()
    none = F.lit(None).cast("string")
    kind = rules.classify_call(
        text.call_method(F.col("call")), text.call_receiver(F.col("call")), none, none, F.col("call").rlike(r"\A\s*[A-Za-z_$][\w$]*\s*\(.*\)\s*\."), fallback=True
    )
    return calls.agg(F.count(F.lit(1)).alias("n_calls"), F.count_if(kind == "fallback").alias("n_fallback"))


@query(r"""SELECT example_id, CASE WHEN i > 0 AND brace > 0 AND (stop = 0 OR stop > brace) THEN true ELSE false END AS has_body FROM (
  SELECT example_id, i, strpos(rest, '{') AS brace, strpos(rest, ';') AS stop FROM (
    SELECT example_id, CASE WHEN regexp_matches(function_source, '\bfunction\s+' || regexp_extract(bare, '\bfunction\s+(\w+)', 1)) THEN 1 ELSE 0 END AS i, regexp_extract(bare, '(?s)\bfunction\s+\w+.*') AS rest
    FROM (SELECT example_id, function_source, regexp_replace(regexp_replace(function_source, '/\*.*?\*/', '', 'gs'), '//[^\n]*', '', 'g') AS bare FROM forge_hyperedge_examples WHERE function_source IS NOT NULL)
    WHERE regexp_matches(bare, '\bfunction\s+\w')))""")
def j07_function_bodies(spark: SparkSession, sf: str) -> DataFrame:
    """C14: whether the first named function of each source is found with a body, which ends where its braces close."""
    bare = F.regexp_replace(F.regexp_replace("function_source", r"(?s)/\*.*?\*/", ""), r"(?d)//.*", "")
    df = _examples(spark, sf).select("example_id", "function_source", F.regexp_extract(bare, r"\bfunction\s+(\w+)", 1).alias("name")).where("name <> ''")
    return solidity.bodies_of(df, "example_id", "function_source", "name").select("example_id", F.col("body").isNotNull().alias("has_body"))


@query(None)
def j01_source_hyperedges(spark: SparkSession, sf: str) -> DataFrame:
    """C1, C2, C4-C6, C10, C13, no cross-contract flag: every example's hyperedge built again from its source."""
    df = _examples(spark, sf).repartition(F.col("example_id"))
    built = solidity.functions_of(df, "example_id", "function_source", "state_vars_accessed")
    call = F.col("c")
    none = F.lit(None).cast("string")
    scope = F.when(F.map_contains_key("locals", call["receiver"]), "local")
    kind = rules.classify_call(call["method"], call["receiver"], F.try_element_at("locals", call["receiver"]), F.coalesce(scope, none), call["is_cast"])
    kinds = built.select("example_id", "locals", F.posexplode("calls").alias("pos", "c")).select("example_id", kind.alias("kind"))
    external = kinds.where("kind is not null").groupBy("example_id").agg(F.count("*").alias("n_calls"))
    hashed = hashed_examples(spark, sf).select("example_id", "hash")
    return built.join(external, "example_id", "left").join(hashed, "example_id").select(
        "example_id", F.size("identifiers").alias("n_vars"), F.coalesce("n_calls", F.lit(0)).alias("n_calls"),
        ((F.size("identifiers") > 0) & (F.coalesce("n_calls", F.lit(0)) > 0)).alias("constructable"), F.size("events").alias("n_events"), "hash",
    )
