"""Queries on the token registry and on explorer rows, and the SQL that DuckDB checks them with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import registry as G
from .sources import solana as N
from .sources.testdata import LEDGER_SQL, ledger_from_tpch


def _mint(n: Column) -> Column:
    """Mints of neighbouring parts share their first ten characters."""
    return F.concat(F.substring(F.md5(F.floor(n / 3).cast("string")), 1, 10), F.md5(n.cast("string")), F.lit("Zz"))


def registry_from_tpch(spark: SparkSession, sf_dir: str, with_known: bool = False) -> DataFrame:
    """part as a token list: tickers repeat after 150 parts, some are reserved, every sixth mint is known."""
    n = F.col("p_partkey")
    symbol = F.when(n % 97 == 0, "BTC").otherwise(F.concat(F.lit(" t"), (n % 150).cast("string")))
    listed = spark.read.parquet(f"{sf_dir}/part.parquet").select(_mint(n).alias("mint"), symbol.alias("symbol"), F.when(n % 4 > 0, F.concat(F.lit("Token "), n.cast("string"))).alias("name"), (n % 10).alias("decimals"), (n % 6 == 0).alias("known"), n.alias("rank"))
    return G.token_registry(listed, with_known=with_known)


def named_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view with assets as exports write them: cut-off mints, short labels, whole mints, tickers, look-alikes."""
    n, seq = F.substring("asset", 2, 20).cast("long"), F.col("seq")
    mint, k = _mint(n), F.pmod(F.col("seq"), F.lit(9))
    short = F.concat(F.substring(mint, 1, 4), F.lit("…"), F.right(mint, F.lit(4)))
    asset = (
        F.when(k == 0, F.upper(F.substring(mint, 1, 8))).when(k == 1, F.substring(mint, 1, 12)).when(k == 2, short).when(k == 3, mint).when(k == 4, F.concat(F.lit("T"), (n % 150).cast("string")))
        .when(k == 5, F.concat(F.lit("USD"), F.when(n % 2 == 0, "Т").otherwise("X"))).when(k == 6, F.when(n % 2 == 0, "MSOL").otherwise("AAVE")).when(k == 7, F.upper(F.substring(mint, 1, 6))).otherwise(F.col("asset"))
    )
    return ledger_from_tpch(spark, sf_dir).withColumns({
        "asset": asset, "token_mint": F.when(seq % 5 == 0, mint), "counter_asset": F.when(seq % 4 == 0, F.upper(F.substring(_mint(n + 1), 1, 11))),
        "source": F.when(F.pmod(seq, F.lit(7)) > 0, "solana").otherwise("kraken"),
    })


def _renamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.renamed_fragments(named_ledger(spark, sf_dir), registry_from_tpch(spark, sf_dir)).select("id", "asset", "token_mint", "counter_asset", "renamed")


ME = "Wa11et"


def explorer_from_tpch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as an explorer's rows, an order a transaction: of the order numbers mod 16, 0 is a vault's, 1 margin, 2 and 3 lending, 4 a farm's, 5
    and 6 a pool's, 7 has slivers of the coin, 15 no signature."""
    o, ln, part, mint = F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"), F.lit(None).cast("string")
    m, j = F.pmod(o, F.lit(16)), F.pmod(ln + o, F.lit(6))
    unlisted = F.concat(F.md5(F.concat(F.lit("u"), (part % 50).cast("string"))), F.lit("UnlistedUU"))
    into, pool, farm, claim = (ln + F.floor(o / 16)) % 2 == 0, m.isin(5, 6) & (ln == 1), (m == 4) & (ln <= 2), (m == 7) & (j == 1)
    address = F.when((m == 0) & (ln == 1), N.VAULT_SHARES[0]).when(farm, G.KNOWN[4][0]).when(pool, unlisted).when(j == 0, N.WRAPPED).when(j == 2, G.KNOWN[5][0]).when(j == 3, _mint(part)).when(j == 4, unlisted)
    token = F.when(address.isNull() & (j == 1), "SOL").when(address.isNull(), F.concat(F.lit("T"), (part % 150).cast("string")))
    other = F.when((m == 0) & (ln == 2), N.VAULT_PROGRAM).when((m == 2) & (ln == 1), N.LENDING_AUTHORITIES[0]).when((m == 4) & (ln == 2), N.FARM_AUTHORITIES[0]).otherwise(F.concat(F.lit("x"), (o % 7).cast("string")))
    flow = F.when(F.when(farm, ln == 1).otherwise(into), "in").otherwise("out")
    amount = F.when(claim, 5_000_000).when(farm, o % 100 + 1).when((ln % 3 == 0) | (ln == 5), F.col("l_quantity").cast("long") * 1_000_000_000).when(ln % 3 == 1, F.col("l_quantity").cast("long") * 1_000_000).otherwise(F.col("l_quantity").cast("long"))
    decimals = F.when(claim, 9).when(farm | (ln == 5), 0).when(ln % 3 == 0, 9).when(ln % 3 == 1, 6).otherwise(0)
    value = F.when(claim, 0.5).when((ln + part) % 4 == 0, -1.0).when((ln + part) % 4 == 1, 0.0).otherwise(F.col("l_extendedprice"))
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.when(m != 15, F.concat(F.lit("sig"), o.cast("string"))).alias("signature"), F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss").alias("human_time"), F.when(ln == 7, "close account").otherwise("Transfer").alias("action"),
        F.when(flow == "out", ME).otherwise(other).alias("from"), F.when(flow == "out", other).otherwise(ME).alias("to"), amount.cast("string").alias("amount"), flow.alias("flow"), value.cast("string").alias("value"), decimals.cast("string").alias("decimals"),
        F.lit("1").alias("multiplier"), address.alias("token_address"), token.alias("token"), F.when(pool, F.when(into, "mint").otherwise("burn")).alias("token_change"),
        F.when(m == 1, "drift").when(m == 3, "MRGN").when(m == 5, "RAYDIUM").alias("helius_source"), F.when(m == 5, "ADD_LIQUIDITY").alias("helius_type"), (o * 10 + ln).alias("seq"), mint.alias("extra"),
    )


def _routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = N.parse_solana(explorer_from_tpch(spark, sf_dir), registry_from_tpch(spark, sf_dir, True), ME)
    return x.select("id", "timestamp", "asset", "transaction_type", "amount", "fiat_value_at_trigger", "fiat_currency", "transfer_direction", "counter_asset", "counterparty_address", "token_mint", "trade_group_id", "venue_order_type")


QUERIES = {
    "solana_routes": _routes,
    "renamed_fragments": _renamed,
    "asset_labels": lambda s, d: G.asset_labels(named_ledger(s, d), registry_from_tpch(s, d)),
}

_REGISTRY = """
tok AS (SELECT left(md5((p_partkey // 3)::varchar), 10) || md5(p_partkey::varchar) || 'Zz' AS mint, CASE WHEN p_partkey % 97 = 0 THEN 'BTC' ELSE 'T' || (p_partkey % 150) END AS symbol,
  CASE WHEN p_partkey % 4 > 0 THEN 'Token ' || p_partkey WHEN p_partkey % 97 = 0 THEN 'BTC' ELSE 'T' || (p_partkey % 150) END AS name, p_partkey % 6 = 0 AS known, p_partkey AS rank FROM part)"""
_NAMED = """
m AS (SELECT *, substr(asset, 2)::bigint AS n FROM ledger),
named AS (SELECT id, seq, CASE WHEN seq % 5 = 0 THEN mint END AS token_mint, CASE WHEN seq % 7 > 0 THEN 'solana' ELSE 'kraken' END AS source, CASE WHEN seq % 4 = 0 THEN upper(left(mint1, 11)) END AS counter,
  CASE seq % 9 WHEN 0 THEN upper(left(mint, 8)) WHEN 1 THEN left(mint, 12) WHEN 2 THEN left(mint, 4) || '…' || right(mint, 4) WHEN 3 THEN mint WHEN 4 THEN 'T' || (n % 150) WHEN 5 THEN 'USD' || CASE WHEN n % 2 = 0 THEN 'Т' ELSE 'X' END
    WHEN 6 THEN CASE WHEN n % 2 = 0 THEN 'MSOL' ELSE 'AAVE' END WHEN 7 THEN upper(left(mint, 6)) ELSE asset END AS asset
  FROM (SELECT *, left(md5((n // 3)::varchar), 10) || md5(n::varchar) || 'Zz' AS mint, left(md5(((n + 1) // 3)::varchar), 10) || md5((n + 1)::varchar) || 'Zz' AS mint1 FROM m)),
texts AS (SELECT DISTINCT unnest([asset, counter]) AS text FROM named),
frag AS (SELECT text, CASE WHEN length(text) = 8 OR count(*) = 1 OR bool_or(known) THEN arg_min({'mint': mint, 'symbol': symbol, 'name': name}, (NOT known, rank)) END AS t
  FROM texts JOIN tok ON starts_with(upper(mint), upper(text)) WHERE regexp_full_match(text, '[A-Za-z0-9]{4,12}') AND text NOT IN ('MSOL', 'AAVE', 'BTC') GROUP BY text)"""
_KNOWN_SQL = ", ".join(f"('{m}', '{s}', '{n}', {i - len(G.KNOWN)})" for i, (m, s, n, _) in enumerate(G.KNOWN))
_CORE_SQL = "('SOL', 'MSOL', 'BSOL', 'JITOSOL', 'JTO', 'WSOL', 'USDC', 'USDT')"
_RAW_SQL = f"""
raw AS (SELECT *, CASE WHEN m = 0 AND ln = 1 THEN '{N.VAULT_SHARES[0]}' WHEN farm THEN '{G.KNOWN[4][0]}' WHEN pool THEN unlisted WHEN j = 0 THEN '{N.WRAPPED}' WHEN j = 2 THEN '{G.KNOWN[5][0]}'
    WHEN j = 3 THEN left(md5((part // 3)::varchar), 10) || md5(part::varchar) || 'Zz' WHEN j = 4 THEN unlisted END AS address,
    CASE WHEN m = 0 AND ln = 2 THEN '{N.VAULT_PROGRAM}' WHEN m = 2 AND ln = 1 THEN '{N.LENDING_AUTHORITIES[0]}' WHEN m = 4 AND ln = 2 THEN '{N.FARM_AUTHORITIES[0]}' ELSE 'x' || (o % 7) END AS other,
    CASE WHEN farm THEN ln = 1 ELSE up END AS into_,
    CASE WHEN claim THEN 0.005 WHEN farm THEN o % 100 + 1 ELSE q END::decimal(38,12) AS qty,
    CASE WHEN claim THEN 0.5 WHEN (ln + part) % 4 < 2 THEN 0 ELSE price END AS usd
  FROM (SELECT l_orderkey AS o, l_linenumber AS ln, l_partkey AS part, l_orderkey % 16 AS m, (l_linenumber + l_orderkey) % 6 AS j, l_quantity AS q, l_extendedprice AS price, l_shipdate AS when_, (l_linenumber + l_orderkey // 16) % 2 = 0 AS up,
    l_orderkey % 16 IN (5, 6) AND l_linenumber = 1 AS pool, l_orderkey % 16 = 4 AND l_linenumber <= 2 AS farm, l_orderkey % 16 = 7 AND (l_linenumber + l_orderkey) % 6 = 1 AS claim,
    md5('u' || (l_partkey % 50)) || 'UnlistedUU' AS unlisted FROM lineitem WHERE l_linenumber < 7)),
reg AS (SELECT mint, symbol, rank, known FROM tok UNION ALL SELECT m, s, r, true FROM (VALUES {_KNOWN_SQL}) v(m, s, n, r)),
tick AS (SELECT symbol, arg_min(mint, (NOT known, rank)) AS mint FROM reg WHERE symbol NOT IN ('BTC', 'SOL', 'USDC', 'USDT') GROUP BY symbol),
e AS (SELECT raw.*, 'T' || (part % 150) AS tk, CASE WHEN m < 15 THEN 'sig' || o END AS sig, reg.symbol AS rs, tick.mint AS tm FROM raw LEFT JOIN reg ON reg.mint = address LEFT JOIN tick ON address IS NULL AND j = 5 AND tick.symbol = 'T' || (part % 150)),
f AS (SELECT *, asset IN {_CORE_SQL} AS core, asset IN ('SOL', 'WSOL') AND NOT into_ AND qty > 0 AND qty < 0.05 AND usd < 0.01 AS rent, rs IS NULL AND (address IS NOT NULL OR tm IS NULL AND j = 5 AND length(tk) >= 4) AS unknown, coalesce(mint = '{N.VAULT_SHARES[0]}', false) AS share,
    NOT coalesce(mint = '{N.VAULT_SHARES[0]}', false) AND ((address IS NOT NULL AND (rs IS NULL OR rs IN ('BTC', 'SOL', 'USDC', 'USDT')) AND asset NOT IN ('SOL', 'WSOL', 'JTO', 'JITOSOL', 'MSOL', 'BSOL', 'KMNO')) OR (other = '{N.FARM_AUTHORITIES[0]}' AND asset NOT IN {_CORE_SQL})) AS receipt
  FROM (SELECT *, CASE WHEN address IS NULL AND j = 1 THEN 'SOL' WHEN address IS NULL THEN tk WHEN rs IS NULL THEN left(address, 4) || '…' || right(address, 4) ELSE rs END AS asset, CASE WHEN address IS NULL AND j = 1 THEN NULL WHEN address IS NULL THEN coalesce(tm, tk) ELSE address END AS mint FROM e))"""
_LEGS_SQL = f"""
legs AS (SELECT sig, asset, min(when_) AS when_, max(mint) AS mint, count(*) AS n, bool_or(into_) AS h_in, bool_or(NOT into_) AS h_out, any_value(m) AS m, bool_or(core) AS core, bool_or(unknown) AS unknown, bool_or(other = '{N.VAULT_PROGRAM}' OR share) AS hv, bool_or(other = '{N.LENDING_AUTHORITIES[0]}') AS hl,
    bool_or(other = '{N.FARM_AUTHORITIES[0]}') AS hf, sum(CASE WHEN into_ THEN qty ELSE -qty END) AS a_net, coalesce(sum(CASE WHEN into_ THEN qty ELSE -qty END) FILTER (core AND NOT rent), 0) AS c_net,
    coalesce(sum(qty) FILTER (into_ AND NOT receipt AND NOT rent), 0) AS f_i, coalesce(sum(qty) FILTER (NOT into_ AND NOT receipt AND NOT rent), 0) AS f_o, coalesce(sum(CASE WHEN into_ THEN qty ELSE -qty END) FILTER (NOT pool AND NOT rent), 0) AS p_net,
    coalesce(sum(CASE WHEN up THEN qty ELSE -qty END) FILTER (pool), 0) AS s_net, coalesce(sum(u) FILTER (into_), 0) AS a_vi, coalesce(sum(u) FILTER (NOT into_), 0) AS a_vo, coalesce(sum(u) FILTER (into_ AND core AND NOT rent), 0) AS c_vi, coalesce(sum(u) FILTER (NOT into_ AND core AND NOT rent), 0) AS c_vo,
    coalesce(sum(u) FILTER (into_ AND NOT receipt AND NOT rent), 0) AS f_vi, coalesce(sum(u) FILTER (NOT into_ AND NOT receipt AND NOT rent), 0) AS f_vo, coalesce(sum(u) FILTER (NOT pool AND NOT rent), 0) AS p_v, coalesce(sum(u) FILTER (pool), 0) AS s_v
  FROM (SELECT *, round(usd * 1000000)::bigint AS u FROM f) WHERE sig IS NOT NULL GROUP BY sig, asset),
vg AS (SELECT sig, sum(CASE WHEN into_ THEN qty ELSE -qty END) FILTER (share) AS part, coalesce(sum(qty) FILTER (core AND wr AND into_), 0) AS wi, coalesce(sum(qty) FILTER (core AND wr AND NOT into_), 0) AS wo, coalesce(sum(qty) FILTER (core AND NOT wr AND into_), 0) AS ni,
    coalesce(sum(qty) FILTER (core AND NOT wr AND NOT into_), 0) AS no, coalesce(sum(round(usd * 1000000)::bigint) FILTER (core AND into_), 0) AS ui, coalesce(sum(round(usd * 1000000)::bigint) FILTER (core AND NOT into_), 0) AS uo
  FROM (SELECT *, coalesce(mint = '{N.WRAPPED}', false) AS wr FROM f) WHERE sig IS NOT NULL GROUP BY sig HAVING bool_or(share OR other = '{N.VAULT_PROGRAM}')),
vm AS (SELECT sig, CASE WHEN part < 0 AND si > 1e-6 THEN 'IN' WHEN part > 0 AND so > 1e-6 THEN 'OUT' END AS way, CASE WHEN part < 0 THEN si ELSE so END AS sol, CASE WHEN part < 0 THEN ui ELSE uo END AS sv
  FROM (SELECT *, CASE WHEN ni = 0 THEN wi WHEN wi = 0 OR abs(wi - ni)::double <= greatest(wi, ni)::double * 0.01 THEN greatest(wi, ni) ELSE wi + ni END AS si, CASE WHEN no = 0 THEN wo WHEN wo = 0 OR abs(wo - no)::double <= greatest(wo, no)::double * 0.01 THEN greatest(wo, no) ELSE wo + no END AS so FROM vg)),
l1 AS (SELECT *, f_i - f_o AS f_net, f_i > 1e-6 AND f_o > 1e-6 AND abs(f_i - f_o)::double <= greatest(f_i, f_o)::double * 0.01 AS held FROM legs),
l2 AS (SELECT *, f_net < -1e-6 AND NOT (asset IN ('SOL', 'WSOL') AND f_vo < 10000 AND abs(f_net) < 0.05) AS sold FROM l1),
gr AS (SELECT sig, sum(n) AS gn, min(when_) AS g_at, bool_or(h_in) AS gi, bool_or(h_out) AS go, bool_or(hv) AS gv, bool_or(hl) AS gl, bool_or(hf) AS gf, max(m) AS gm, bool_or(abs(c_net) > 1e-6) AS gc, sum(a_vi) AS gai, sum(a_vo) AS gao, sum(f_vi) AS gfi, sum(f_vo) AS gfo,
    CASE WHEN count(*) FILTER (a_net > 1e-6) = 1 THEN max(asset) FILTER (a_net > 1e-6) END AS in1, CASE WHEN count(*) FILTER (a_net < -1e-6) = 1 THEN max(asset) FILTER (a_net < -1e-6) END AS out1, CASE WHEN count(*) FILTER (f_net > 1e-6) = 1 THEN max(asset) FILTER (f_net > 1e-6) END AS fin1,
    CASE WHEN count(*) FILTER (sold) = 1 THEN max(asset) FILTER (sold) END AS sold1, CASE WHEN count(*) FILTER (held) = 1 THEN max(asset) FILTER (held) END AS held1, bool_or(s_net > 0) AS mi, bool_or(s_net < 0) AS bu,
    bool_or(p_net < -1e-6) AS pgo, bool_or(p_net > 1e-6) AS pco, bool_or(core AND p_net < -1e-6) AS cgo, bool_or(core AND p_net > 1e-6) AS cco FROM l2 GROUP BY sig),
l3 AS (SELECT * EXCLUDE (m), CASE WHEN gao >= 10000 AND gai < 10000 AND in1 = asset THEN gao ELSE a_vi END AS si, CASE WHEN gai >= 10000 AND gao < 10000 AND out1 = asset THEN gai ELSE a_vo END AS so,
    CASE WHEN gfo >= 10000 AND gfi < 10000 AND fin1 = asset THEN gfo ELSE f_vi END AS fi, CASE WHEN gfi >= 10000 AND gfo < 10000 AND sold1 = asset THEN gfi ELSE f_vo END AS fo FROM l2 JOIN gr USING (sig)),
l4 AS (SELECT *, CASE WHEN fi <= 0 AND gfo >= 10000 THEN gfo ELSE fi END AS fa FROM l3),
l5 AS (SELECT *, sold AND NOT (fo < 10000 AND unknown AND NOT core) AND NOT (fo > 0 AND fo < 10000) AS fs, f_net > 1e-6 AND NOT held AND NOT (fi < 10000 AND unknown AND NOT core) AND NOT (fi > 0 AND fi < 10000) AS fb, held AND NOT (fa < 10000 AND unknown AND NOT core) AS fh,
    a_net < -1e-6 AND NOT (so < 10000 AND unknown AND NOT core) AND NOT (so > 0 AND so < 10000) AS ss, a_net > 1e-6 AND NOT (si < 10000 AND unknown AND NOT core) AND NOT (si > 0 AND si < 10000) AS sb FROM l4),
l6 AS (SELECT l5.*, bool_or(fs OR fb OR fh) OVER w AS af, count(*) FILTER (ss) OVER w AS ns, count(*) FILTER (sb) OVER w AS nb,
    bool_or(ss AND asset IN ('SOL', 'WSOL', 'JITOSOL', 'MSOL', 'BSOL') AND a_net >= -0.015 AND so > 5000 AND so <= 10000000) OVER w AND bool_or(sb AND asset NOT IN ('SOL', 'WSOL', 'JITOSOL', 'MSOL', 'BSOL', 'USDC', 'USDT')) OVER w AS cl FROM l5 WINDOW w AS (PARTITION BY sig)),
l7 AS (SELECT l6.*, cl AND ns = 1 AND nb = 1 AS claimed, way, sol, sv, CASE WHEN gn < 2 OR NOT gi OR NOT go THEN CASE WHEN gm = 1 AND gc THEN 'drift' WHEN gm <> 1 AND gc AND ((NOT gv AND gl) OR gm = 3) THEN 'lending' ELSE 'single' END
    WHEN way IS NOT NULL THEN 'vault' WHEN gm = 1 AND gc THEN 'drift' WHEN ((NOT gv AND gl) OR gm = 3) AND gc THEN 'lending' WHEN NOT gv AND NOT gl AND gm <> 3 AND gf AND af THEN 'farms'
    WHEN (mi AND CASE WHEN gm = 5 THEN pgo ELSE cgo END) OR (bu AND CASE WHEN gm = 5 THEN pco ELSE cco END) THEN 'pool' WHEN ns + nb > 0 THEN 'swap' ELSE 'single' END AS route FROM l6 LEFT JOIN vm USING (sig))"""
_NONE = "NULL::varchar"
_EVENTS_SQL = f"""
ev AS (
  SELECT sig, g_at AS when_, 'transfer-' || lower(dir) || '-' || asset AS suffix, asset, 'TRANSFER' AS k, abs(c_net) AS qty, v, dir, {_NONE} AS counter, CASE WHEN route = 'drift' THEN '{N.DRIFT_PROGRAM}' WHEN gl THEN '{N.LENDING_AUTHORITIES[0]}' END AS who, mint, CASE WHEN route = 'drift' THEN 'drift_collateral' END AS venue
    FROM (SELECT *, CASE WHEN c_net > 0 THEN 'IN' ELSE 'OUT' END AS dir, CASE WHEN c_net > 0 THEN c_vi ELSE c_vo END AS v FROM l7 WHERE route IN ('drift', 'lending') AND abs(c_net) > 1e-6)
  UNION ALL SELECT DISTINCT sig, g_at, 'transfer-' || lower(way) || '-SOL', 'SOL', 'TRANSFER', sol, sv, way, {_NONE}, {_NONE}, '{N.WRAPPED}', {_NONE} FROM l7 WHERE route = 'vault'
  UNION ALL SELECT sig, g_at, 'sell-' || asset, asset, 'SELL', abs(f_net), fo, {_NONE}, coalesce(held1, fin1), {_NONE}, mint, {_NONE} FROM l7 WHERE route = 'farms' AND fs
  UNION ALL SELECT sig, g_at, 'buy-' || asset, asset, 'BUY', CASE WHEN fh THEN f_i ELSE f_net END, CASE WHEN fh THEN fa ELSE fi END, {_NONE}, sold1, {_NONE}, mint, {_NONE} FROM l7 WHERE route = 'farms' AND (fb OR fh)
  UNION ALL SELECT sig, g_at, 'transfer-out-' || asset, asset, 'TRANSFER', f_i, fa, 'OUT', {_NONE}, '{N.FARM_AUTHORITIES[0]}', mint, {_NONE} FROM l7 WHERE route = 'farms' AND fh
  UNION ALL SELECT sig, g_at, 'lp-' || CASE WHEN p_net > 0 THEN 'in-' ELSE 'out-' END || asset, asset, 'TRANSFER', abs(p_net), p_v, CASE WHEN p_net > 0 THEN 'IN' ELSE 'OUT' END, {_NONE}, {_NONE}, mint, 'amm_lp_pool' FROM l7 WHERE route = 'pool' AND abs(p_net) > 1e-6
  UNION ALL SELECT sig, g_at, 'lp-' || CASE WHEN s_net > 0 THEN 'mint-' ELSE 'burn-' END || mint, asset, 'TRANSFER', abs(s_net), s_v, CASE WHEN s_net > 0 THEN 'IN' ELSE 'OUT' END, {_NONE}, {_NONE}, mint, 'amm_lp' FROM l7 WHERE route = 'pool' AND abs(s_net) > 1e-6
  UNION ALL SELECT sig, g_at, 'sell-' || asset, asset, CASE WHEN claimed THEN 'FEE' ELSE 'SELL' END, abs(a_net), so, {_NONE}, CASE WHEN NOT claimed THEN in1 END, {_NONE}, mint, {_NONE} FROM l7 WHERE route = 'swap' AND ss
  UNION ALL SELECT sig, g_at, 'buy-' || asset, asset, CASE WHEN claimed THEN 'AIRDROP' ELSE 'BUY' END, a_net, si, {_NONE}, CASE WHEN NOT claimed THEN out1 END, {_NONE}, mint, {_NONE} FROM l7 WHERE route = 'swap' AND sb),
one AS (SELECT coalesce('sol-' || sig || '-transfer-', 'sol-' || strftime(when_, '%Y-%m-%dT%H:%M:%S+00:00') || '-transfer-') || CASE WHEN into_ THEN 'in-' ELSE 'out-' END || coalesce(address, asset) AS id, f.when_, o * 10 + ln AS seq, sig, asset, 'TRANSFER' AS k, qty, round(usd * 1000000)::bigint AS v,
    CASE WHEN into_ THEN 'IN' ELSE 'OUT' END AS dir, {_NONE} AS counter, CASE WHEN m = 1 THEN '{N.DRIFT_PROGRAM}' ELSE other END AS who, mint, CASE WHEN m = 1 THEN 'drift_collateral' END AS venue
  FROM f WHERE (sig IS NULL OR sig IN (SELECT sig FROM l7 WHERE route = 'single')) AND NOT unknown AND NOT (core AND into_ AND qty <= 0.0001 AND usd < 0.01)),
every AS (SELECT 'sol-' || sig || '-' || suffix AS id, when_, 0 AS seq, sig, asset, k, qty, v, dir, counter, who, mint, venue FROM ev UNION ALL SELECT * FROM one QUALIFY row_number() OVER (PARTITION BY id ORDER BY when_, seq, asset, k, qty) = 1)
SELECT id, when_ AS timestamp, asset, k AS transaction_type, round(qty, 9)::double AS amount, round(v::double / 1000000, 2) AS fiat_value_at_trigger, CASE WHEN k <> 'TRANSFER' OR v > 0 THEN 'USD' END AS fiat_currency, dir AS transfer_direction, counter AS counter_asset,
  who AS counterparty_address, mint AS token_mint, sig AS trade_group_id, venue AS venue_order_type FROM every"""
SQL = {
    "solana_routes": f"WITH {_REGISTRY}, {_RAW_SQL}, {_LEGS_SQL}, {_EVENTS_SQL}",
    "renamed_fragments": f"""WITH {LEDGER_SQL}, {_REGISTRY}, {_NAMED}
SELECT id, coalesce(a.t.symbol, asset) AS asset, coalesce(a.t.mint, token_mint) AS token_mint, coalesce(c.t.symbol, counter) AS counter_asset, a.t IS NOT NULL OR c.t IS NOT NULL AS renamed
FROM named LEFT JOIN frag a ON a.text = asset AND token_mint IS NULL AND source = 'solana' LEFT JOIN frag c ON c.text = counter""",
    "asset_labels": f"""WITH {LEDGER_SQL}, {_REGISTRY}, {_NAMED},
keys AS (SELECT asset, min(seen) AS seen, bool_or(source = 'solana') AS chain FROM (SELECT asset, token_mint AS seen, source FROM named UNION ALL SELECT counter, NULL, source FROM named) WHERE asset IS NOT NULL GROUP BY asset),
short AS (SELECT asset, CASE WHEN count(*) = 1 OR count(*) FILTER (known) = 1 THEN arg_min({{'mint': mint, 'symbol': symbol, 'name': name}}, (NOT known, rank)) END AS t
  FROM keys JOIN tok ON contains(asset, '…') AND starts_with(mint, split_part(asset, '…', 1)) AND ends_with(mint, split_part(asset, '…', 2)) GROUP BY asset),
sym AS (SELECT symbol, arg_min({{'mint': mint, 'symbol': symbol, 'name': name}}, (NOT known, rank)) AS t FROM tok WHERE symbol <> 'BTC' GROUP BY symbol),
x AS (SELECT k.*, CASE
    WHEN contains(k.asset, '…') THEN coalesce(short.t, {{'mint': NULL, 'symbol': k.asset, 'name': 'Unknown SPL token'}})
    WHEN NOT regexp_full_match(k.asset, '[\\x00-\\x7F]*') THEN {{'mint': NULL, 'symbol': k.asset, 'name': 'Unverified token (possible scam)'}}
    WHEN seen IS NOT NULL AND s.mint IS NOT NULL THEN {{'mint': s.mint, 'symbol': s.symbol, 'name': s.name}}
    WHEN k.asset = 'MSOL' THEN {{'mint': NULL, 'symbol': 'MSOL', 'name': 'Marinade Staked SOL'}}
    WHEN length(k.asset) > 31 THEN CASE WHEN w.mint IS NULL THEN {{'mint': k.asset, 'symbol': left(k.asset, 4) || '…' || right(k.asset, 4), 'name': 'Unknown SPL token'}} ELSE {{'mint': w.mint, 'symbol': w.symbol, 'name': w.name}} END
    WHEN k.asset = 'AAVE' THEN {{'mint': NULL, 'symbol': 'AAVE', 'name': 'AAVE'}}
    WHEN frag.t IS NOT NULL THEN frag.t WHEN chain AND sym.t IS NOT NULL THEN sym.t ELSE {{'mint': NULL, 'symbol': k.asset, 'name': upper(k.asset)}} END AS t
  FROM keys k LEFT JOIN short ON short.asset = k.asset LEFT JOIN tok s ON s.mint = seen LEFT JOIN tok w ON w.mint = k.asset LEFT JOIN frag ON frag.text = k.asset LEFT JOIN sym ON sym.symbol = upper(k.asset))
SELECT asset, t.symbol AS symbol, CASE WHEN t.symbol = 'BTC' THEN 'Bitcoin' ELSE t.name END AS name, t.mint AS mint, CASE WHEN asset = 'USDТ' THEN 'USDT' END AS resembles FROM x""",
}
