"""Rows of a Solana explorer or provider as ledger rows.

Every row is one movement of a token in a transaction. Rows are first given quantity, ticker and marks (bits of one number) of their
own. Then each transaction's movements are netted by ticker under the views that routes have of it (all rows, core tokens, staked
principal, pool tokens, minted shares), in one grouped aggregation that combines in the tasks. What the transaction shows picks its
route: vault, margin collateral, lending, farms, pool, swap or single transfers; a route that yields nothing hands on to the
next. A transaction holds at most some hundred accounts, so windows over its netted legs are small whatever the ledger's size; its
raw rows are never gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.lineage import stored
from ..functions.spread import look_up
from ..operators import registry as G
from ..operators.ledger_ops import is_spam
from .files import number, when_utc
from .testdata import conform

# Programs, authorities and tokens of protocols, providers' names of them, and bounds.
WRAPPED = "So11111111111111111111111111111111111111112"
VAULT_PROGRAM = "KvauGMspG5k6rtzrqqn7WNn3oZdyKqLKwK2XWQ8FLjd"
VAULT_SHARES = ("FiM4VQdXXnTXL7GgChryf9zHNG9cmvKECwf34L2y3CkN",)
LENDING_AUTHORITIES = ("9DrvZvyWh1HuAoZxvYWMvkf2XCzryCpGgHqrMjyDWpmo",)
LENDING_TYPES = ("DEPOSIT_RESERVE", "WITHDRAW_OBLIGATION", "BORROW_OBLIGATION", "FLASH_REPAY", "REFRESH_OBLIGATION", "REPAY_OBLIGATION")
MARGINFI_PROGRAM = "MFv2hWf31Z9kbCa1snEPYctwafyhdvnV7FZnsebVacA"
MARGINFI_AUTHORITIES = (MARGINFI_PROGRAM, "4qp6Fx6tnZkY5Wropq9wUYgtFxXKwE6viZxFHg3rdAG8")
MARGINFI_SOURCES = ("MARGINFI", "MARGIN_FI", "MRGN")
FARM_AUTHORITIES = ("FTj3SbJuawWT42Wj2GWxmbqLXNpXFE4ypE1bN17Sh5J5",)
FARM_PRINCIPAL = ("SOL", "WSOL", "JTO", "JITOSOL", "MSOL", "BSOL", "KMNO")
DRIFT_PROGRAM, DRIFT_SOURCES = "dRiftyHA39MWEi3m9aunc5MzRF1JYuBsbn6VPcn33UH", ("DRIFT",)
POOL_TYPES = ("ADD_LIQUIDITY", "WITHDRAW_LIQUIDITY", "REMOVE_LIQUIDITY", "REMOVE_LIQUIDITY_BY_RANGE", "REMOVE_LIQUIDITY_SINGLE_SIDE", "INCREASE_LIQUIDITY", "DECREASE_LIQUIDITY")
POOL_SOURCES = ("RAYDIUM", "ORCA", "METEORA", "PUMP_AMM", "PUMP_FUN", "LIFINITY", "ALDRIN", "SAROS", "CREMA", "CROPPER", "STEP_FINANCE", "MERCURIAL")
CORE = ("SOL", "MSOL", "BSOL", "JITOSOL", "JTO", "WSOL")
CLAIM_OUT = ("SOL", "WSOL", "JITOSOL", "MSOL", "BSOL")
RENT = (890_880, 1_057_920, 2_039_280, 1_651_400, 7_294_080)
DECIMALS_TRIED = (9, 6, 8, 5)
EPS, DUST, RENT_MOST, CLOSE = 1e-6, 1e-4, 0.05, 0.01
LEAST, CLAIM_SOL, CLAIM_USD = 10_000, 0.015, 10_000_000  # values in millionths

TEXT = ("signature", "human_time", "action", "from", "to", "flow", "token", "token_address", "token_change", "helius_source", "helius_type")
QTY = "decimal(38,12)"
MICRO = 1_000_000  # values are summed as whole millionths
MARKS = ("core", "scam", "unknown", "in_vault", "drift", "lends", "marginfi", "lend_type", "in_farm", "pool_type", "comes", "goes", "pool_comes", "pool_goes", "core_pool_comes", "core_pool_goes", "minted", "burnt", "moves_core", "farmed")


def _yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _filled(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _bits(**marks: Column) -> Column:
    out = F.lit(0)
    for name, c in marks.items():
        out = out.bitwiseOR(F.when(c, 1 << MARKS.index(name)).otherwise(0))
    return out


def _has(name: str, column: str = "marks") -> Column:
    return F.col(column).bitwiseAND(1 << MARKS.index(name)) != 0


def is_core(asset: Column) -> Column:
    return _yes(F.upper(asset).isin(*CORE)) | S.is_stable(asset)


def quantity(raw: Column, decimals: Column, multiplier: Column, value: Column) -> Column:
    """Whole units of a raw amount. Without decimals they are inferred from the value, by the first that gives a possible price."""
    d, m = decimals.cast("int"), F.when(multiplier == 0, 1.0).otherwise(multiplier)
    guess = F.lit(None).cast("double")
    for n in reversed(DECIMALS_TRIED):
        trial = raw / F.lit(10.0**n) * m
        price = F.try_divide(value, trial)
        guess = F.when((trial > 0) & (price >= 1e-9) & (price <= 5_000_000), trial).otherwise(guess)
    inferred = F.when((d == 0) & (raw >= 1000) & (value > 0), guess)
    blind = F.when((d == 0) & (raw >= 1_000_000) & (value <= 0), raw / F.lit(1e9) * m)
    return F.when(d < 0, 0.0).otherwise(F.coalesce(inferred, blind, raw / F.pow(F.lit(10.0), d) * m))


def _tokens(x: DataFrame, registry: DataFrame) -> DataFrame:
    """Rows with `found`, the registry's token of their mint or ticker; each mint and ticker is looked up once."""
    keys = stored(x.select("_m", "_text").distinct())
    mints = keys.where("_m is not null").select("_m").distinct().join(G.by_key(registry.select(F.col("mint").alias("_m"), F.struct("mint", "symbol", "name").alias("_mt"))), "_m")
    texts = keys.where("_text is not null").select(F.col("_text").alias("text")).distinct()
    by_ticker = texts.join(G.by_key(G.by_symbol(registry)), F.upper(F.trim("text")) == F.col("symbol")).select("text", F.col("token").alias("t1"))
    by_prefix = G.resolved_fragments(texts, registry).select("text", F.col("token").alias("t2"))
    names = texts.join(by_ticker, "text", "left").join(by_prefix, "text", "left").select(F.col("text").alias("_text"), F.coalesce("t1", "t2").alias("_t")).where("_t is not null")
    x = look_up(look_up(x, stored(mints), "_m"), stored(names), "_text")
    return x.withColumn("found", F.coalesce("_mt", "_t")).drop("_m", "_text", "_mt", "_t")


def explorer_rows(df: DataFrame, registry: DataFrame) -> DataFrame:
    """Rows of action `transfer` with what their own columns say: sig, at, flow, a, b, asset, mint, qty, usd, marks.

    df: columns of strings with normalised names (`files.read_export`); missing ones are null. Rows without a readable time are left
    out, quantities of over 26 digits count as 0. Tickers come from the registry: by mint, else by ticker, else by cut-off mint.
    """

    def text(c: str) -> Column:
        t = F.trim(F.col(f"`{c}`").cast("string")) if c in df.columns else F.lit("")
        return F.when(F.lower(t) == "nan", "").otherwise(F.coalesce(t, F.lit("")))

    n = {c: number(F.col(c).cast("string")) if c in df.columns else F.lit(0.0) for c in ("amount", "value", "decimals", "multiplier")}
    order = F.col("seq").cast("long") if "seq" in df.columns else F.lit(0).cast("long")
    x = df.where(F.lower(text("action")) == "transfer").select(
        text("signature").alias("sig"), when_utc(text("human_time")).alias("at"), F.lower(text("flow")).alias("flow"), text("from").alias("a"), text("to").alias("b"), text("token").alias("token"), text("token_address").alias("address"),
        F.lower(text("token_change")).alias("change"), F.upper(text("helius_source")).alias("provider"), F.upper(text("helius_type")).alias("kind"), n["amount"].alias("raw"), *[n[c].alias(c) for c in ("value", "decimals", "multiplier")], order.alias("seq"),
    ).where("at is not null")
    qty = F.coalesce(quantity(F.col("raw"), F.col("decimals"), F.col("multiplier"), F.col("value")).try_cast(QTY), F.lit(0).cast(QTY))
    usd = F.coalesce(F.round(F.greatest("value", F.lit(0.0)) * MICRO).try_cast("long"), F.lit(0).cast("long"))
    x = x.withColumns({"qty": qty, "usd": usd, "own_mint": F.when(F.length("address") >= 32, F.col("address")).when(F.length("token") >= 32, F.col("token")).when(F.col("address") != "", F.col("address")).otherwise(F.col("token"))})
    x = x.withColumn("whole", F.length("own_mint") >= 32)
    x = x.withColumns({"_m": F.when(F.col("whole"), F.col("own_mint")), "_text": F.when(~F.col("whole") & (F.col("token") != "") & (F.upper("token") != "SOL"), F.col("token"))})
    x = _tokens(x, registry)
    native = ~F.col("whole") & (F.upper("token") == "SOL")
    plain = ~F.col("whole") & F.col("token").rlike("^[A-Za-z]{1,6}$")
    found = F.col("found")
    asset = F.when(native, "SOL").when(found.isNotNull(), found["symbol"]).when(plain, F.upper("token")).when(F.col("own_mint") != "", G.short_mint(F.col("own_mint"))).otherwise("UNKNOWN")
    token_mint = F.when(native, None).when(found.isNotNull(), found["mint"]).when(~plain, _filled(F.col("own_mint")))
    x = x.withColumns({"asset": asset, "mint": token_mint, "listed": found.isNotNull()}).drop("found")
    x = x.withColumns({"core": is_core(F.col("asset")), "label": G.is_label(F.col("asset")), "long_mint": _yes(F.length("mint") >= 32)})
    touches = lambda *who: F.col("a").isin(*who) | F.col("b").isin(*who)
    share, core = _yes(F.col("mint").isin(*VAULT_SHARES)), F.col("core")
    rent = F.col("asset").isin("SOL", "WSOL") & (F.col("flow") == "out") & (F.floor("raw").isin(*RENT) | ((F.col("qty") > 0) & (F.col("qty") < RENT_MOST) & (F.col("usd") < LEAST)))
    unlisted = (F.col("long_mint") | F.col("label")) & ~(F.col("listed") & ~G.is_reserved(F.col("asset")))
    in_farm = touches(*FARM_AUTHORITIES)
    x = x.withColumns({
        "share": share, "rent": rent, "wrapped": _yes(F.col("mint") == WRAPPED) | (F.col("asset") == "WSOL"), "supply": F.col("change").isin("burn", "mint"),
        "receipt": ~share & ((unlisted & ~F.upper("asset").isin(*FARM_PRINCIPAL)) | (in_farm & ~core)),
        "marks": _bits(
            core=core, scam=is_spam(F.col("asset")) & ~core, unknown=~core & ~F.col("listed") & (F.col("label") | F.col("long_mint") | G.is_fragment(F.col("asset"))),
            in_vault=touches(VAULT_PROGRAM) | F.col("own_mint").isin(*VAULT_SHARES), drift=F.col("provider").isin(*DRIFT_SOURCES), lends=touches(*LENDING_AUTHORITIES, *MARGINFI_AUTHORITIES),
            marginfi=touches(*MARGINFI_AUTHORITIES) | F.contains("address", F.lit(MARGINFI_PROGRAM)) | F.col("provider").isin(*MARGINFI_SOURCES) | F.contains("kind", F.lit("MARGINFI")),
            lend_type=F.col("kind").rlike("|".join(LENDING_TYPES)), in_farm=in_farm, pool_type=F.col("kind").isin(*POOL_TYPES) | (F.col("kind").isin("DEPOSIT", "WITHDRAW") & F.col("provider").isin(*POOL_SOURCES)),
            comes=F.col("flow") == "in", goes=F.col("flow") == "out",
        ),
    })
    return x.drop("whole", "own_mint", "listed", "label", "long_mint", "raw", "decimals", "multiplier", "value", "provider", "kind", "token")


def infer_wallet(rows: DataFrame) -> DataFrame:
    """(wallet): the address that most rows speak for, of equals the least; one row, or none."""
    who = F.when(F.col("flow") == "out", F.col("a")).when(F.col("flow") == "in", F.col("b"))
    return rows.select(who.alias("wallet")).where("wallet is not null").groupBy("wallet").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "wallet").limit(1).select("wallet")


def _sum(cond: Column, c: Column, zero: Column) -> Column:
    return F.sum(F.when(cond, c).otherwise(zero))


def netted_legs(rows: DataFrame) -> DataFrame:
    """One row a transaction and ticker: net quantities and values of each view, and the marks of its rows."""
    into, qty, usd, none, free = F.col("flow") == "in", F.col("qty"), F.col("usd"), F.lit(0).cast(QTY), F.lit(0).cast("long")
    signed, moved = F.when(into, qty).otherwise(-qty), (qty > 0) & ~F.col("rent")
    core, farm, pool = F.col("core") & moved, ~F.col("receipt") & moved, ~F.col("supply") & moved

    def authority(*who: str) -> Column:
        x = F.coalesce(F.when(F.col("b").isin(*who), F.col("b")), F.when(F.col("a").isin(*who), F.col("a")))
        return F.min(F.when(x.isNotNull(), F.struct("seq", x.alias("who"))))["who"]

    return rows.where("sig <> ''").groupBy("sig", "asset").agg(
        F.sum(signed).alias("all_net"), _sum(core, signed, none).alias("core_net"), _sum(farm & into, qty, none).alias("farm_in"), _sum(farm & ~into, qty, none).alias("farm_out"), _sum(pool, signed, none).alias("pool_net"),
        _sum(F.col("supply") & (qty > 0), F.when(F.col("change") == "mint", qty).otherwise(-qty), none).alias("s_net"),
        _sum(into, usd, free).alias("all_vin"), _sum(~into, usd, free).alias("all_vout"), _sum(core & into, usd, free).alias("core_vin"), _sum(core & ~into, usd, free).alias("core_vout"),
        _sum(farm & into, usd, free).alias("farm_vin"), _sum(farm & ~into, usd, free).alias("farm_vout"), _sum(pool, usd, free).alias("pool_v"), _sum(F.col("supply") & (qty > 0), usd, free).alias("s_v"),
        F.bit_or("marks").alias("marks"), F.count("*").alias("n"), F.min("at").alias("first_at"), F.max("mint").alias("mint"), authority(*LENDING_AUTHORITIES, *MARGINFI_AUTHORITIES).alias("lender"), authority(*FARM_AUTHORITIES).alias("farm"),
    )


def vault_moves(rows: DataFrame) -> DataFrame:
    """(sig, way, sol, sol_usd): transactions of the vault in which shares went one way and the coin the other."""
    into, qty, usd, none, free = F.col("flow") == "in", F.col("qty"), F.col("usd"), F.lit(0).cast(QTY), F.lit(0).cast("long")
    coin = F.col("core") & ~F.col("share")
    wrapped, native = coin & F.col("wrapped"), coin & ~F.col("wrapped")
    g = rows.where("sig <> '' and qty > 0").groupBy("sig").agg(
        F.bit_or("marks").alias("marks"), _sum(F.col("share"), F.when(into, qty).otherwise(-qty), none).alias("part"), *[_sum(w & side, qty, none).alias(f"{n}_{k}") for n, w in (("w", wrapped), ("n", native)) for k, side in (("in", into), ("out", ~into))],
        _sum(coin & into, usd, free).alias("usd_in"), _sum(coin & ~into, usd, free).alias("usd_out"),
    ).where(_has("in_vault"))

    def both(w: Column, n: Column) -> Column:
        """Wrapped and native legs of one movement count once, if about equal; else both."""
        close = F.abs(w - n).cast("double") <= F.greatest(w, n).cast("double") * CLOSE
        return F.when(n <= EPS, w).when((w <= EPS) | close, F.greatest(w, n)).otherwise(w + n)

    g = g.withColumns({"sol_in": both(F.col("w_in"), F.col("n_in")), "sol_out": both(F.col("w_out"), F.col("n_out"))})
    way = F.when((F.col("part") < -EPS) & (F.col("sol_in") > EPS), "IN").when((F.col("part") > EPS) & (F.col("sol_out") > EPS), "OUT")
    g = g.withColumn("way", way).where("way is not null")
    return g.select("sig", "way", F.when(F.col("way") == "IN", F.col("sol_in")).otherwise(F.col("sol_out")).alias("sol"), F.when(F.col("way") == "IN", F.col("usd_in")).otherwise(F.col("usd_out")).alias("sol_usd"))


def with_routes(legs: DataFrame, vaults: DataFrame) -> DataFrame:
    """Legs with `route`, what their transaction shows, and which of them are events of the farms' and the swaps' routes."""
    w = Window.partitionBy("sig")
    x = legs.withColumns({"farm_net": F.col("farm_in") - F.col("farm_out"), "staked": (F.col("farm_in") > EPS) & (F.col("farm_out") > EPS) & (F.abs(F.col("farm_in") - F.col("farm_out")).cast("double") <= F.greatest("farm_in", "farm_out").cast("double") * CLOSE)})
    rent_like = F.col("asset").isin("SOL", "WSOL") & (F.col("farm_vout") < LEAST) & (F.abs("farm_net") < RENT_MOST)
    x = x.withColumns({"sold": (F.col("farm_net") < -EPS) & ~rent_like, "marks": F.col("marks").bitwiseOR(_bits(
        pool_comes=F.col("pool_net") > EPS, pool_goes=F.col("pool_net") < -EPS, core_pool_comes=_has("core") & (F.col("pool_net") > EPS), core_pool_goes=_has("core") & (F.col("pool_net") < -EPS),
        minted=F.col("s_net") > EPS, burnt=F.col("s_net") < -EPS, moves_core=F.abs("core_net") > EPS,
    ))})

    def only(cond: Column) -> Column:
        """The ticker, if one leg has it."""
        name = F.when(cond, F.col("asset"))
        return F.when(F.count(name).over(w) == 1, F.max(name).over(w))

    x = x.withColumns({
        "g": F.bit_or("marks").over(w), "g_n": F.sum("n").over(w), "g_at": F.min("first_at").over(w), "g_lender": F.min("lender").over(w), "g_farm": F.min("farm").over(w), **{f"g_{c}": F.sum(c).over(w) for c in ("all_vin", "all_vout", "farm_vin", "farm_vout")},
        "in_only": only(F.col("all_net") > EPS), "out_only": only(F.col("all_net") < -EPS), "farm_in_only": only(F.col("farm_net") > EPS), "sold_only": only(F.col("sold")), "staked_only": only(F.col("staked")),
    })

    def sides(view: str, in_only: str, out_only: str) -> tuple[Column, Column]:
        """Values of what came in and went out: a side without a value takes the other side's, if one leg stands for it."""
        came, went, asset = F.col(f"g_{view}_vin"), F.col(f"g_{view}_vout"), F.col("asset")
        into = F.when((went >= LEAST) & (came < LEAST) & _yes(F.col(in_only) == asset), went).otherwise(F.col(f"{view}_vin"))
        return into, F.when((came >= LEAST) & (went < LEAST) & _yes(F.col(out_only) == asset), came).otherwise(F.col(f"{view}_vout"))

    s_in, s_out = sides("all", "in_only", "out_only")
    f_in, f_out = sides("farm", "farm_in_only", "sold_only")
    x = x.withColumns({"s_in": s_in, "s_out": s_out, "f_in": f_in, "f_out": f_out})
    x = x.withColumn("f_all", F.when((F.col("f_in") <= 0) & (F.col("g_farm_vout") >= LEAST), F.col("g_farm_vout")).otherwise(F.col("f_in")))
    odd = _has("unknown") & ~_has("core")

    def event(fiat: str, slight: bool = True) -> Column:
        """Legs of a swap that are an event: not of advertised tokens, nor of unknown ones without a value, nor of under a cent."""
        v = F.col(fiat)
        return ~_has("scam") & ~((v < LEAST) & odd) & (~((v > 0) & (v < LEAST)) if slight else F.lit(True))

    x = x.withColumns({
        "f_sell": F.col("sold") & event("f_out"), "f_buy": (F.col("farm_net") > EPS) & ~F.col("staked") & event("f_in"), "f_held": F.col("staked") & event("f_all", False),
        "s_sell": (F.col("all_net") < -EPS) & event("s_out"), "s_buy": (F.col("all_net") > EPS) & event("s_in"),
    })
    # One token in for a sliver of the chain's own coin is a claim: the token comes as an airdrop, the coin pays for it.
    spent = F.col("s_sell") & F.upper("asset").isin(*CLAIM_OUT) & (F.col("all_net") >= -CLAIM_SOL) & (F.col("s_out") > LEAST // 2) & (F.col("s_out") <= CLAIM_USD)
    got = F.col("s_buy") & ~S.is_stable(F.col("asset")) & ~F.upper("asset").isin(*CLAIM_OUT)
    x = x.withColumns({"any_farm": F.max(F.col("f_buy") | F.col("f_sell") | F.col("f_held")).over(w), "n_sell": F.count_if("s_sell").over(w), "n_buy": F.count_if("s_buy").over(w), "claim": F.max(spent).over(w) & F.max(got).over(w)})
    x = x.withColumn("claim", F.col("claim") & (F.col("n_sell") == 1) & (F.col("n_buy") == 1)).join(vaults, "sig", "left")
    h = lambda m: _has(m, "g")
    lends = (~h("in_vault") & (h("lends") | h("lend_type"))) | h("marginfi")
    goes, comes = F.when(h("pool_type"), h("pool_goes")).otherwise(h("core_pool_goes")), F.when(h("pool_type"), h("pool_comes")).otherwise(h("core_pool_comes"))
    route = (
        F.when((F.col("g_n") < 2) | ~h("comes") | ~h("goes"), F.when(h("drift") & h("moves_core"), "drift").when(~h("drift") & lends & h("moves_core"), "lending").otherwise("single"))
        .when(F.col("way").isNotNull(), "vault").when(h("drift") & h("moves_core"), "drift").when(lends & h("moves_core"), "lending").when(~h("in_vault") & ~lends & h("in_farm") & F.col("any_farm"), "farms")
        .when((h("minted") & goes) | (h("burnt") & comes), "pool").when(F.col("n_sell") + F.col("n_buy") > 0, "swap").otherwise("single")
    )
    return x.withColumn("route", route)


EVENT = "suffix string, kind string, qty decimal(38,12), fiat long, way string, counter string, who string, venue string, asset string, mint string"


def _event(when: Column, suffix: Column, kind: Column | str, qty: Column, fiat: Column, **more: Column | str) -> Column:
    value = {"suffix": suffix, "kind": kind, "qty": qty.cast(QTY), "fiat": fiat, "way": None, "counter": None, "who": None, "venue": None, "asset": F.col("asset"), "mint": F.col("mint")} | more
    kinds = dict(x.split(" ") for x in EVENT.split(", "))
    return F.when(when, F.struct(*[(v if isinstance(v, Column) else F.lit(v)).cast(kinds[k]).alias(k) for k, v in value.items()]))


def _events(legs: DataFrame) -> DataFrame:
    """The ledger events of each leg by its route: at most three of its own and one of minted shares."""
    r, asset = F.col("route"), F.col("asset")
    named = lambda prefix: F.concat(F.lit(prefix), asset)
    core, pool = F.when(F.col("core_net") > 0, "IN").otherwise("OUT"), F.when(F.col("pool_net") > 0, "IN").otherwise("OUT")
    drift = r == "drift"
    moved = _event(r.isin("drift", "lending") & (F.abs("core_net") > EPS), F.concat(F.lit("transfer-"), F.lower(core), F.lit("-"), asset), "TRANSFER", F.abs("core_net"), F.when(F.col("core_net") > 0, F.col("core_vin")).otherwise(F.col("core_vout")),
                   way=core, who=F.when(drift, DRIFT_PROGRAM).otherwise(F.col("g_lender")), venue=F.when(drift, "drift_collateral"))
    pooled = _event((r == "pool") & (F.abs("pool_net") > EPS), F.concat(F.lit("lp-"), F.lower(pool), F.lit("-"), asset), "TRANSFER", F.abs("pool_net"), F.col("pool_v"), way=pool, venue="amm_lp_pool")
    farm_sell = _event((r == "farms") & F.col("f_sell"), named("sell-"), "SELL", F.abs("farm_net"), F.col("f_out"), counter=F.coalesce("staked_only", "farm_in_only"))
    swap_sell = _event((r == "swap") & F.col("s_sell"), named("sell-"), F.when(F.col("claim"), "FEE").otherwise("SELL"), F.abs("all_net"), F.col("s_out"), counter=F.when(~F.col("claim"), F.col("in_only")))
    farm_buy = _event((r == "farms") & (F.col("f_buy") | F.col("f_held")), named("buy-"), "BUY", F.when(F.col("f_held"), F.col("farm_in")).otherwise(F.col("farm_net")), F.when(F.col("f_held"), F.col("f_all")).otherwise(F.col("f_in")), counter=F.col("sold_only"))
    swap_buy = _event((r == "swap") & F.col("s_buy"), named("buy-"), F.when(F.col("claim"), "AIRDROP").otherwise("BUY"), F.col("all_net"), F.col("s_in"), counter=F.when(~F.col("claim"), F.col("out_only")))
    held = _event((r == "farms") & F.col("f_held"), named("transfer-out-"), "TRANSFER", F.col("farm_in"), F.col("f_all"), way="OUT", who=F.col("g_farm"))
    minted = F.col("s_net") > 0
    shares = _event((r == "pool") & (F.abs("s_net") > EPS), F.concat(F.lit("lp-"), F.when(minted, "mint").otherwise("burn"), F.lit("-"), F.coalesce("mint", "asset")), "TRANSFER", F.abs("s_net"), F.col("s_v"), way=F.when(minted, "IN").otherwise("OUT"), venue="amm_lp")
    first = F.row_number().over(Window.partitionBy("sig").orderBy("asset")) == 1
    vault = _event((r == "vault") & F.col("first"), F.concat(F.lit("transfer-"), F.lower("way"), F.lit("-SOL")), "TRANSFER", F.col("sol"), F.col("sol_usd"), way=F.col("way"), asset="SOL", mint=WRAPPED)
    every = F.array(F.coalesce(moved, pooled, farm_sell, swap_sell, vault), F.coalesce(farm_buy, swap_buy), held, shares)
    x = legs.withColumn("first", first).where("route <> 'single'").select("sig", F.col("g_at").alias("at"), F.explode(every).alias("e")).where("e is not null")
    return x.select(F.concat(F.lit("sol-"), F.col("sig"), F.lit("-"), F.col("e.suffix")).alias("id"), "sig", "at", F.lit(0).cast("long").alias("seq"), "e.*")


def _singles(rows: DataFrame, wallet: DataFrame) -> DataFrame:
    """Rows of no other route, each a transfer; unknown tokens, dust that came in and advertised tokens are left out."""
    dust = F.col("core") & (F.col("flow") == "in") & (F.col("qty") > 0) & (F.col("qty") <= DUST) & (F.col("usd") < LEAST)
    x = rows.where(~_has("scam") & ~dust & ~_has("unknown") & (F.col("qty") >= EPS)).join(F.broadcast(wallet), F.lit(True), "left")
    into = F.when(F.col("flow") == "in", True).when(F.col("flow") == "out", False).otherwise(_yes(F.col("b") == F.col("wallet")))
    stamp = F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    ident = F.concat_ws("-", F.lit("sol"), F.coalesce(_filled(F.col("sig")), stamp), F.lit("transfer"), "flow", F.coalesce(_filled(F.col("address")), F.col("asset")))
    who = F.when(_has("drift"), DRIFT_PROGRAM).otherwise(_filled(F.when(into, F.col("a")).otherwise(F.col("b"))))
    return x.select(
        ident.alias("id"), _filled(F.col("sig")).alias("sig"), "at", "seq", F.lit(None).cast("string").alias("suffix"), F.lit("TRANSFER").alias("kind"), "qty", F.col("usd").alias("fiat"), F.when(into, "IN").otherwise("OUT").alias("way"),
        F.lit(None).cast("string").alias("counter"), who.alias("who"), F.when(_has("drift"), "drift_collateral").alias("venue"), "asset", "mint",
    )


def parse_solana(df: DataFrame, registry: DataFrame, wallet: str | None = None) -> DataFrame:
    """The ledger rows of an explorer's or provider's rows; `registry` as of `registry.token_registry`.

    A transaction is the rows of one signature; rows without one are transfers of their own. Rows of other actions, without a readable time or of a
    malformed number are left out or count as 0. Quantities are rounded to 9 places, values to cents. An id counts once, its earliest
    row, of one time the first by `seq`. Repeated rows of a transaction add up, as in the export; mints of one ticker in a
    transaction are one leg. An empty table gives no rows.
    """
    rows = stored(explorer_rows(df, registry))
    legs = stored(with_routes(netted_legs(rows), vault_moves(rows)))
    own = rows.sparkSession.createDataFrame([(wallet,)], "wallet string") if wallet else infer_wallet(rows)
    alone = legs.where("route = 'single'").select("sig").distinct()
    single = _singles(rows.where("sig = ''").unionByName(rows.join(alone, "sig", "left_semi").select(*rows.columns)), own)
    every = _events(legs).unionByName(single)
    rest = [c for c in every.columns if c not in ("id", "at", "seq")]
    x = every.groupBy("id").agg(F.min(F.struct("at", "seq", *rest)).alias("x")).select("id", "x.*")
    value = F.round(F.col("fiat").cast("double") / MICRO, 2)
    return conform(x.select(
        "id", F.col("at").alias("timestamp"), "asset", F.col("kind").alias("transaction_type"), F.round("qty", 9).cast("double").alias("amount"), value.alias("fiat_value_at_trigger"), F.lit(0.0).alias("fee_fiat"),
        F.when((F.col("kind") != "TRANSFER") | (F.col("fiat") > 0), "USD").alias("fiat_currency"), F.lit("solana").alias("source"), F.col("way").alias("transfer_direction"), F.col("counter").alias("counter_asset"),
        F.col("who").alias("counterparty_address"), F.col("sig").alias("trade_group_id"), F.col("sig").alias("on_chain_tx_id"), F.col("mint").alias("token_mint"), F.col("venue").alias("venue_order_type"), "seq",
    ))
