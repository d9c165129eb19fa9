"""The token registry: mints to tickers, by mint, ticker, cut-off mint and short label, and what is built on it.

A registry has the columns mint, symbol, name, decimals, known, rank. Lookups join tables of one row a key: a cut-off mint
meets an index of all prefixes with what each stands for, so no mint is compared with a text it doesn't begin with. Keys
are resolved once each, then given back to their rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.lineage import cut
from ..functions.spread import look_up

# Tickers that no token of the chain may claim.
RESERVED = (
    "BTC", "ETH", "ETHW", "SOL", "ADA", "DOT", "AVAX", "MATIC", "POL", "LINK", "UNI", "ATOM", "XRP", "LTC", "BCH", "XLM", "DOGE", "BNB", "CRO", "CHZ", "ENA", "VET", "LUNA", "LUNC",
    "LUNA2", "REZ", "WEN", "MOODENG", "MUBI", "KDA", "1000FLOKI", "ARB", "OP", "TIA", "HYPE", "INJ", "NEAR", "APT", "SUI", "SEI", "FTM", "ALGO", "HBAR", "FIL", "ICP", "AAVE", "MKR", "CRV",
    "SNX", "COMP", "GRT", "SAND", "MANA", "APE", "SHIB", "PEPE", "USDT", "USDC", "DAI", "TUSD", "USDP", "PYUSD", "BUSD",
)
# Names of assets that exchanges list.
NAMES = {
    "BTC": "Bitcoin", "ETH": "Ethereum", "ETHW": "Ethereum PoW (fork)", "SOL": "Solana", "ADA": "Cardano", "DOT": "Polkadot", "AVAX": "Avalanche", "MATIC": "Polygon", "POL": "Polygon",
    "LINK": "Chainlink", "UNI": "Uniswap", "ATOM": "Cosmos", "XRP": "Ripple", "LTC": "Litecoin", "DOGE": "Dogecoin", "BNB": "BNB Chain", "CRO": "Cronos", "CHZ": "Chiliz", "ENA": "Ethena",
    "VET": "VeChain", "LUNA": "Terra", "LUNC": "Terra Classic", "LUNA2": "Terra 2.0", "REZ": "Renzo", "WEN": "Wen (Solana)", "MOODENG": "Moo Deng", "MUBI": "Multibit", "KDA": "Kadena",
    "1000FLOKI": "1000FLOKI (perp unit)", "ARB": "Arbitrum", "OP": "Optimism", "TIA": "Celestia", "HYPE": "Hyperliquid", "INJ": "Injective", "NEAR": "NEAR", "APT": "Aptos", "SUI": "Sui",
    "SEI": "Sei", "MSOL": "Marinade Staked SOL", "BSOL": "BlazeStake Staked SOL", "JITOSOL": "Jito Staked SOL", "JTO": "Jito", "USDC": "USD Coin", "USDT": "Tether USD", "USDT0": "USDT0",
    "DAI": "Dai", "BUSD": "Binance USD", "TUSD": "TrueUSD", "USDP": "Pax Dollar", "PYUSD": "PayPal USD", "BABY": "Babylon",
}
# Mints that are known without a list, and cut-off forms that stand for one mint.
KNOWN = (
    ("So11111111111111111111111111111111111111112", "SOL", "Wrapped SOL", 9),
    ("mSoLzYCxHdYgdzU16g5QSh3i5K3z3KZK7ytfqcJm7So", "MSOL", "Marinade staked SOL", 9),
    ("J1toso1uCk3RLmjorhTtrVwY9HJ7X8V9yYac6Y7kGCPn", "JITOSOL", "Jito Staked SOL", 9),
    ("bSo13r4TkiE4KumL71LsHTPkpLWEywMUht6qBDkWeA", "BSOL", "BlazeStake Staked SOL", 9),
    ("jtojtome8JDRCnn4g1NSEzNoYRrGjoc15W3DjcnMnvJB", "JTO", "Jito", 9),
    ("EPjFWdd5AufqSSqeM2qN1xzybapC8G4wEGGkZwyTDt1v", "USDC", "USD Coin", 6),
    ("Es9vMFrzaCERmJfrF4H2FYD4KCoNkY11McCe8BenwNYB", "USDT", "Tether USD", 6),
    ("FiM4VQdXXnTXL7GgChryf9zHNG9cmvKECwf34L2y3CkN", "KAMINOVAULT", "Kamino Earn SOL Vault Shares", 6),
)
ALIASES = {"JTOJTOME": "jtojtome8JDRCnn4g1NSEzNoYRrGjoc15W3DjcnMnvJB", "BSO13R4T": "bSo13r4TkiE4KumL71LsHTPkpLWEywMUht6qBDkWeA", "GDFNESIA": "GDfnEsia2WLAW5t8yx2X5j2mkfA74i5kwGdDuZHt7XmG"}
NO_FRAGMENTS = ("SOL", "MSOL", "BSOL", "JITOSOL", "JTO")
SHORTEST, LONGEST = 4, 31
TOKEN = "mint string, symbol string, name string, decimals int, known boolean, rank long"
#: Letters of other scripts that look like a capital of ours, for what a suspicious ticker resembles.
CONFUSABLE = ("АВСЕНІЈКМОРЅТХУΑΒΕΖΗΙΚΜΝΟΡΤΥΧ₮ѕоасерхуі", "ABCEHIJKMOPSTXYABEZHIKMNOPTYXTSOACEPXYI")


def _named(values: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def is_reserved(symbol: Column) -> Column:
    return F.upper(F.trim(symbol)).isin(*RESERVED)


def short_mint(mint: Column) -> Column:
    x = F.trim(mint)
    return F.when(F.length(x) <= 12, F.upper(x)).otherwise(F.concat(F.substring(x, 1, 4), F.lit("…"), F.right(x, F.lit(4))))


def is_mint(text: Column) -> Column:
    return F.coalesce(F.trim(text).rlike("^[A-Za-z0-9]{32,48}$"), F.lit(False))


def is_fragment(text: Column) -> Column:
    """4 to 12 letters and digits that aren't one of the chain's own tickers."""
    x = F.trim(text)
    return F.coalesce(x.rlike("^[A-Za-z0-9]{4,12}$") & ~F.upper(x).isin(*NO_FRAGMENTS), F.lit(False))


def label_parts(text: Column) -> tuple[Column, Column]:
    """Begin and end of a short label such as Abcd…Wxyz or Abcd...Wxyz; empty where it is none."""
    x = F.trim(text)
    form = "^([^…]+?)(?:…|\\.\\.\\.)(.+)$"
    return F.regexp_extract(x, form, 1), F.regexp_extract(x, form, 2)


def is_label(text: Column) -> Column:
    return F.coalesce(F.length(label_parts(text)[0]) > 0, F.lit(False))


def token_registry(listed: DataFrame, with_known: bool = True) -> DataFrame:
    """One row a mint of (mint, symbol, name, decimals[, known][, rank]); tickers in upper case, rows without mint or ticker left out.

    A mint listed more than once counts as its first row by rank, then by ticker, a listed row before a known one. Without ranks
    the order is that of the mints. The mints of `KNOWN` are added.
    """
    have = {c: F.col(c) if c in listed.columns else F.lit(None) for c in ("known", "rank")}
    x = listed.select(F.trim("mint").alias("mint"), F.upper(F.trim("symbol")).alias("symbol"), F.trim("name").alias("name"), F.col("decimals").cast("int").alias("decimals"),
                      F.coalesce(have["known"].cast("boolean"), F.lit(False)).alias("known"), F.coalesce(have["rank"].cast("long"), F.lit(0)).alias("rank"), F.lit(0).alias("_own"))
    if with_known:
        own = listed.sparkSession.createDataFrame([(*k, True, i - len(KNOWN)) for i, k in enumerate(KNOWN)], TOKEN)
        x = x.unionByName(own.withColumn("_own", F.lit(1)))
    x = x.where("mint <> '' and symbol <> ''")
    best = F.min_by(F.struct("symbol", F.when(F.length("name") > 0, F.col("name")).otherwise(F.col("symbol")).alias("name"), "decimals"), F.struct("_own", "rank", "symbol", "name"))
    return x.groupBy("mint").agg(best.alias("x"), F.max("known").alias("known"), F.min("rank").alias("rank")).select("mint", "x.*", "known", "rank")


def _best(known_first: bool = True) -> Column:
    """The mint that stands for a key: known ones first, then by rank, then by mint."""
    return F.min_by(F.struct("mint", "symbol", "name"), F.struct(F.when(F.col("known") & F.lit(known_first), 0).otherwise(1), "rank", "mint"))


def by_symbol(registry: DataFrame) -> DataFrame:
    """(symbol, token): reserved tickers have none."""
    return registry.where(~is_reserved(F.col("symbol"))).groupBy("symbol").agg(_best().alias("token"))


def by_fragment(registry: DataFrame, aliases: dict[str, str] = ALIASES) -> DataFrame:
    """(fragment, token): every prefix of a mint, in upper case, that stands for one token.

    One of 8 characters stands for a known mint that has it, else for the first listed; others must belong to one mint or to a known
    one. Reserved tickers and prefixes of under 4 characters stand for nothing; aliases come before all.
    """
    n = F.explode(F.sequence(F.lit(SHORTEST), F.least(F.length("mint"), F.lit(LONGEST))))
    x = registry.where(F.length("mint") >= SHORTEST).select("mint", "symbol", "name", "known", "rank", n.alias("n"))
    return _standing(x.withColumn("fragment", F.upper(F.expr("substring(mint, 1, n)"))), registry, aliases)


def _standing(prefixes: DataFrame, registry: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """(fragment, token): what each fragment of `prefixes` stands for, and the aliases."""
    g = prefixes.groupBy("fragment").agg(F.count("*").alias("n"), F.max("known").alias("known"), _best().alias("token"))
    g = g.where(((F.col("n") == 1) | F.col("known") | (F.length("fragment") == 8)) & ~is_reserved(F.col("fragment"))).select("fragment", "token")
    to = _named({v: k for k, v in aliases.items()}, F.col("mint"))
    alias = registry.where(to.isNotNull()).select(to.alias("fragment"), F.struct("mint", "symbol", "name").alias("token"))
    return g.join(F.broadcast(alias.select("fragment")), "fragment", "left_anti").unionByName(alias)


def by_key(df: DataFrame) -> DataFrame:
    """A table that grows with the registry, for a join: dealt by key. Spark would take the size of the list's file for that of its
    prefixes, many times as many, and gather them in the driver for a broadcast."""
    return df.hint("merge")


def resolved_fragments(texts: DataFrame, registry: DataFrame, aliases: dict[str, str] = ALIASES) -> DataFrame:
    """(text, token) of the texts (text) that are a cut-off mint. Of the mints only prefixes as long as some text are made, and of
    those only the ones that a text has are kept."""
    keys = texts.select(F.trim("text").alias("text")).where("text is not null").distinct().withColumn("fragment", F.upper("text"))
    size = F.length("fragment")
    lengths = sorted(r.n for r in keys.where(size.between(SHORTEST, LONGEST)).select(size.alias("n")).distinct().collect())  # at most 28
    n = F.explode(F.filter(F.array(*[F.lit(i) for i in lengths]).cast("array<int>"), lambda i: i <= F.length("mint")))
    x = registry.select("mint", "symbol", "name", "known", "rank", n.alias("n")).withColumn("fragment", F.upper(F.expr("substring(mint, 1, n)")))
    x = x.join(by_key(keys.select("fragment").distinct()), "fragment", "left_semi")
    return keys.join(by_key(_standing(x, registry, aliases)), "fragment").select("text", "token")


def resolved_labels(texts: DataFrame, registry: DataFrame) -> DataFrame:
    """(text, token) of the short labels that one mint has, or one known mint; cases count."""
    begin, end = label_parts(F.col("text"))
    keys = texts.select("text").distinct().where(is_label(F.col("text"))).withColumns({"begin": begin, "end": end}).withColumn("n", F.least(F.length("begin"), F.lit(8)))
    keys = keys.withColumn("key", F.expr("substring(begin, 1, n)"))
    lengths = F.explode(F.sequence(F.lit(1), F.lit(8)))
    mints = registry.select("mint", "symbol", "name", "known", "rank", lengths.alias("n")).withColumn("key", F.expr("substring(mint, 1, n)"))
    # A key of 8 characters meets few mints; the label's ends settle the rest.
    x = keys.join(by_key(mints), ["n", "key"]).where(F.startswith("mint", F.col("begin")) & F.endswith("mint", F.col("end")))
    g = x.groupBy("text").agg(F.count("*").alias("n"), F.sum(F.col("known").cast("int")).alias("k"), _best().alias("token"))
    return g.where("n = 1 or k = 1").select("text", "token")


def renamed_fragments(ledger: DataFrame, registry: DataFrame, chain: str = "solana") -> DataFrame:
    """The ledger with cut-off mints of the chain's rows without a mint as tickers and mints, and those of counter assets as tickers; `renamed`
    says whether the row changed. Null assets stay; an empty registry changes nothing."""
    mine = (F.col("source") == chain) & (F.coalesce(F.length("token_mint"), F.lit(0)) == 0) & is_fragment(F.col("asset"))
    other = is_fragment(F.col("counter_asset"))
    x = ledger.withColumns({"_a": F.when(F.coalesce(mine, F.lit(False)), F.trim("asset")), "_c": F.when(other, F.trim("counter_asset"))})
    found = cut(resolved_fragments(x.select(F.explode(F.array("_a", "_c")).alias("text")), registry))
    for c in ("_a", "_c"):
        x = look_up(x, found.select(F.col("text").alias(c), F.col("token").alias(f"{c}t")), c)
    new = {c: F.when(F.col(f"{c}t.symbol") != F.upper(F.col(c)), F.col(f"{c}t")) for c in ("_a", "_c")}
    x = x.withColumns({"_an": new["_a"], "_cn": new["_c"]})
    return x.withColumns({
        "asset": F.coalesce("_an.symbol", "asset"), "token_mint": F.coalesce("_an.mint", "token_mint"), "counter_asset": F.coalesce("_cn.symbol", "counter_asset"),
        "renamed": F.col("_an").isNotNull() | F.col("_cn").isNotNull(),
    }).select(*ledger.columns, "renamed")


def _display(symbol: Column, fallback: Column) -> Column:
    """The list's name of a ticker; where it has none, the fallback unless that is the ticker."""
    sym = F.upper(F.trim(symbol))
    return F.coalesce(F.nullif(_named(NAMES, sym), sym), F.when(F.upper(F.trim(fallback)) != sym, fallback), sym)


def asset_labels(ledger: DataFrame, registry: DataFrame, chain: str = "solana") -> DataFrame:
    """(asset, symbol, name, mint, resembles): what to show for each asset and counter asset of a ledger.

    In this order: short labels by the registry; tickers with characters beyond ASCII are suspicious, and `resembles` has the ticker they
    look like; the mint seen with the asset; names of listed assets; whole mints; reserved tickers; cut-off mints; tickers of the chain's
    tokens, for assets of the chain's rows; else the asset itself. Null and empty assets have no label.
    """
    on_chain = F.coalesce(F.col("source") == chain, F.lit(False))
    keys = ledger.select(F.explode(F.array(F.struct(F.col("asset").alias("asset"), F.col("token_mint").alias("seen")), F.struct(F.col("counter_asset").alias("asset"), F.lit(None).cast("string").alias("seen")))).alias("k"), on_chain.alias("chain"))
    keys = cut(keys.select("k.*", "chain").where("asset <> ''").groupBy("asset").agg(F.min(F.nullif("seen", F.lit(""))).alias("seen"), F.max("chain").alias("chain")))
    texts = keys.select(F.col("asset").alias("text"))
    token = registry.select(F.col("mint").alias("_m"), F.struct("mint", "symbol", "name").alias("t"))
    x = keys.withColumn("_text", F.trim("asset")).join(by_key(resolved_labels(texts, registry).select(F.col("text").alias("asset"), F.col("token").alias("_label"))), "asset", "left")
    x = x.join(by_key(resolved_fragments(texts, registry).select(F.col("text").alias("_text"), F.col("token").alias("_fragment"))), "_text", "left")
    x = x.join(by_key(token.withColumnRenamed("t", "_seen")), F.col("seen") == F.col("_m"), "left").drop("_m").join(by_key(token.withColumnRenamed("t", "_whole")), F.col("_text") == F.col("_m"), "left").drop("_m")
    x = x.withColumn("_sym", F.upper("_text")).join(by_key(by_symbol(registry).select(F.col("symbol").alias("_sym"), F.col("token").alias("_symbol"))), "_sym", "left")

    def shown(t: str) -> Column:
        return F.struct(F.col(f"{t}.symbol").alias("symbol"), _display(F.col(f"{t}.symbol"), F.col(f"{t}.name")).alias("name"), F.col(f"{t}.mint").alias("mint"))

    def fixed(symbol: Column, name: Column, mint: Column | None = None) -> Column:
        return F.struct(symbol.alias("symbol"), name.alias("name"), (F.lit(None).cast("string") if mint is None else mint).alias("mint"))

    asset, unknown = F.col("asset"), F.lit("Unknown SPL token")
    listed = _named(NAMES, F.col("_sym"))
    odd = F.col("_text").rlike("[^\\x00-\\x7F]")
    label = (
        F.when(is_label(asset) & F.col("_label").isNotNull(), shown("_label")).when(is_label(asset), fixed(asset, unknown))
        .when(odd, fixed(asset, F.lit("Unverified token (possible scam)")))
        .when(F.col("_seen").isNotNull(), shown("_seen"))
        .when(listed != F.col("_sym"), fixed(F.col("_sym"), listed))
        .when(is_mint(asset) & F.col("_whole").isNotNull(), shown("_whole")).when(is_mint(asset), fixed(short_mint(asset), unknown, asset))
        .when(is_reserved(asset) | listed.isNotNull(), fixed(F.col("_sym"), F.coalesce(listed, F.col("_sym"))))
        .when(is_fragment(asset) & F.col("_fragment").isNotNull(), shown("_fragment"))
        .when(F.col("chain") & F.col("_symbol").isNotNull(), shown("_symbol"))
        .otherwise(fixed(asset, _display(asset, asset)))
    )
    folded = F.upper(F.translate(F.col("_text"), *CONFUSABLE))
    resembles = F.when(odd & ~is_label(asset) & (is_reserved(folded) | S.is_stable(folded)), folded)
    return x.select("asset", label.alias("x"), resembles.alias("resembles")).select("asset", "x.*", "resembles")
