"""Exports and provider payloads as ledger rows.

Each parser takes string columns with normalised names (see `files.read_export`) or parsed JSON and returns the ledger's columns. Rows whose
time can't be read, and kinds that have no meaning for the ledger, are left out. Ids come from the row's content where the
venue gives none, so that a second import of the same file gives the same ids.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from .files import number, when_utc
from .testdata import conform

# Column names that mean the same, and words for transaction types.
ALIASES = {
    "id": ("id", "txid", "tx_id", "transaction_id", "reference"), "timestamp": ("timestamp", "time", "date", "datetime", "executed_at"), "asset": ("asset", "symbol", "currency", "coin", "token"),
    "transaction_type": ("transaction_type", "type", "side", "action", "operation"), "amount": ("amount", "quantity", "qty", "size", "units"),
    "fiat_value_at_trigger": ("fiat_value_at_trigger", "fiat_value", "usd_value", "value_usd", "total", "subtotal"), "fee_fiat": ("fee_fiat", "fee", "fees", "fee_usd", "commission"),
    "source": ("source", "exchange", "wallet", "ledger", "platform"),
}
TYPES = {
    "buy": "BUY", "purchase": "BUY", "deposit": "BUY", "sell": "SELL", "sale": "SELL", "withdrawal": "SELL", "withdraw": "SELL", "airdrop": "AIRDROP",
    "reward": "STAKING", "staking": "STAKING", "stake": "STAKING", "interest": "STAKING", "fee": "FEE", "transfer": "TRANSFER",
}
# Venue codes of assets.
CODES = {"XXBT": "BTC", "XBT": "BTC", "XETH": "ETH", "XLTC": "LTC", "XXRP": "XRP", "XDOGE": "DOGE", "XXDG": "DOGE", "ZUSD": "USD", "ZEUR": "EUR", "ZGBP": "GBP", "ZCAD": "CAD", "ZAUD": "AUD", "ZJPY": "JPY", "ZCHF": "CHF", "CROWN2": "CROWN"}
REWARDS = ("staking rewards", "simple earn flexible interest", "simple earn locked interest", "earn", "referral commission", "distribution", "airdrop", "mission reward")


def _map(values: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def _content_id(prefix: str, *cols) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("\u001f", *[F.coalesce(c.cast("string") if isinstance(c, Column) else F.col(c).cast("string"), F.lit("")) for c in cols]), 256), 1, 32))


def _code(c: Column) -> Column:
    x = F.upper(F.trim(c))
    return F.coalesce(_map(CODES, x), x)


def _text(df: DataFrame, name: str) -> Column:
    return F.trim(F.col(name)) if name in df.columns else F.lit(None).cast("string")


def is_fiat(asset: Column) -> Column:
    return F.coalesce(asset.isin(*S.FIATS), F.lit(False))


def parse_generic(df: DataFrame) -> DataFrame:
    first = {k: next((_text(df, c) for c in names if c in df.columns), F.lit(None).cast("string")) for k, names in ALIASES.items()}
    word = F.lower(first["transaction_type"])
    kind = F.coalesce(_map(TYPES, word), F.when(F.upper(word).isin("BUY", "SELL", "AIRDROP", "STAKING", "FEE", "TRANSFER"), F.upper(word)))
    own = F.when(F.length(first["id"]) > 0, first["id"])
    out = df.select(
        F.coalesce(own, _content_id("row-", *[first[k] for k in ("timestamp", "asset", "transaction_type", "amount", "fiat_value_at_trigger", "source")])).alias("id"),
        when_utc(first["timestamp"]).alias("timestamp"), S.normalise_asset(first["asset"]).alias("asset"), kind.alias("transaction_type"), number(first["amount"]).alias("amount"),
        F.greatest(F.lit(0.0), number(first["fiat_value_at_trigger"])).alias("fiat_value_at_trigger"), number(first["fee_fiat"]).alias("fee_fiat"), F.nullif(first["source"], F.lit("")).alias("source"),
    )
    return conform(out.where("timestamp is not null and transaction_type is not null and asset is not null"))


def parse_kraken(df: DataFrame) -> DataFrame:
    """Trades are grouped by refid: partial fills sum up by asset and side and take the value of the quote legs."""
    x = df.select(
        _text(df, "txid").alias("txid"), F.nullif(_text(df, "refid"), F.lit("")).alias("refid"), when_utc(F.col("time")).alias("timestamp"), F.lower(_text(df, "type")).alias("kind"), F.lower(F.coalesce(_text(df, "subtype"), F.lit(""))).alias("subtype"),
        _code(F.col("asset")).alias("asset"), number(F.col("amount")).alias("change"), number(_text(df, "fee")).alias("fee"),
    ).where("timestamp is not null")
    quote = is_fiat(F.col("asset")) | S.is_stable(F.col("asset"))
    t = x.where("kind = 'trade' and refid is not null").withColumn("quote", quote)
    g = Window.partitionBy("refid")
    t = t.withColumns({
        "spent": F.sum(F.when(F.col("quote") & (F.col("change") < 0), -F.col("change")).otherwise(0)).over(g), "got": F.sum(F.when(F.col("quote") & (F.col("change") > 0), F.col("change")).otherwise(0)).over(g),
        "fiat": F.max(F.when(is_fiat(F.col("asset")), F.col("asset"))).over(g), "stable": F.max(F.when(S.is_stable(F.col("asset")), F.col("asset"))).over(g),
        "at": F.min("timestamp").over(g), "out_leg": F.min(F.when(~F.col("quote") & (F.col("change") < 0), F.struct("txid", "asset", "change"))).over(g), "in_leg": F.min(F.when(~F.col("quote") & (F.col("change") > 0), F.struct("txid", "asset", "change"))).over(g),
    })
    b = t.where(~F.col("quote") & (F.col("change") != 0)).groupBy("refid", "asset", (F.col("change") > 0).alias("buy")).agg(
        F.sum(F.abs("change")).alias("amount"), F.sum("fee").alias("fee"), F.min("txid").alias("txid"), *[F.first(c).alias(c) for c in ("spent", "got", "fiat", "stable", "at", "out_leg", "in_leg")]
    )
    other = F.when(F.col("buy"), F.col("out_leg")).otherwise(F.col("in_leg"))
    value = F.when(F.col("buy"), F.col("spent")).otherwise(F.col("got"))
    value = F.when(value > 0, value).otherwise(F.coalesce(F.abs(other["change"]), F.lit(0.0)))
    counter = F.when(F.col("fiat").isNull(), F.coalesce("stable", other["asset"]))
    trades = b.select(
        F.coalesce(F.nullif("txid", F.lit("")), _content_id("kraken-", "refid", "asset", "buy")).alias("id"), F.col("at").alias("timestamp"), "asset", F.when(F.col("buy"), "BUY").otherwise("SELL").alias("transaction_type"), "amount",
        F.round(value, 2).alias("fiat_value_at_trigger"), F.round(F.when((value > 0) & (F.col("fee") > 0), F.col("fee") * value / F.col("amount")).otherwise(0.0), 4).alias("fee_fiat"),
        F.coalesce("fiat", counter).alias("fiat_currency"), counter.alias("counter_asset"), F.col("refid").alias("trade_group_id"), F.lit("kraken").alias("source"),
    )
    k, stable, fiat, q = F.col("kind"), S.is_stable(F.col("asset")), is_fiat(F.col("asset")), F.abs("change")
    kind = (
        F.when(k.isin("deposit", "receive"), F.when(fiat, None).when(stable, "BUY").otherwise("TRANSFER")).when(k == "withdrawal", F.when(~fiat, "TRANSFER")).when(k.isin("spend", "sale"), "SELL").when(k == "transfer", "TRANSFER")
        .when(k.isin("staking", "dividend", "earn"), F.when(F.col("subtype").isin("allocation", "deallocation"), "TRANSFER").otherwise("STAKING")).when(k == "fee", "FEE")
    )
    parked = k.isin("spend", "sale") & ~stable & ~fiat & (F.col("fee") > q * 0.05)  # a fiat notional in the fee column
    value = F.when(k.isin("deposit", "receive", "spend", "sale", "staking", "dividend", "earn") & (kind != "TRANSFER") & (stable | (k.isin("spend", "sale") & fiat & (F.col("fee") > 0))), q).when(parked, F.col("fee")).otherwise(0.0)
    fee = F.when(parked, 0.0).otherwise(F.col("fee"))
    single = x.where("kind <> 'trade'").where((q > 0) | (k == "fee")).select(
        F.coalesce(F.nullif("txid", F.lit("")), _content_id("kraken-", "refid", "kind", "asset", "change", "timestamp")).alias("id"), "timestamp", "asset", kind.alias("transaction_type"), q.alias("amount"), F.round(value, 2).alias("fiat_value_at_trigger"),
        F.round(F.when((value > 0) & (q > 0), fee * value / q).otherwise(fee), 4).alias("fee_fiat"), F.when(stable & (value > 0), F.col("asset")).when(parked, F.lit("GBP")).alias("fiat_currency"), F.col("refid").alias("trade_group_id"), F.lit("kraken").alias("source"),
        F.when(k.isin("deposit", "receive") & (kind == "TRANSFER"), "IN").when(k == "withdrawal", "OUT").alias("transfer_direction"),
    )
    return conform(trades.unionByName(single.where("transaction_type is not null"), allowMissingColumns=True))


def parse_exchange_ledger(df: DataFrame, filename: str = "") -> DataFrame:
    """Rows of one time and account are a trade if one of them says so. A "(UTC+1)" in the file's name shifts the times."""
    m = re.search(r"UTC([+-])(\d{1,2})(?::(\d{2}))?", filename, re.IGNORECASE)
    shift = (1 if m[1] == "+" else -1) * (int(m[2]) * 60 + int(m[3] or 0)) if m else 0
    time = F.col("utc_time") if "utc_time" in df.columns else F.col("time")
    remark = F.lower(F.coalesce(_text(df, "remark"), F.lit("")))
    x = df.select(
        (when_utc(time) - F.make_dt_interval(mins=F.lit(shift))).alias("timestamp"), F.coalesce(_text(df, "account"), F.lit("")).alias("account"), F.lower(_text(df, "operation")).alias("op"), _code(F.col("coin")).alias("asset"), number(F.col("change")).alias("change"),
        F.when(remark.contains("binance"), "binance").when(remark.contains("crypto.com") | remark.contains("cryptocom"), "cryptocom").otherwise("binance" if "user_id" in df.columns else "exchange").alias("source"),
    ).where("timestamp is not null")
    g = Window.partitionBy("timestamp", "account")
    fiat, deal = is_fiat(F.col("asset")), F.col("op") == "transaction related"
    x = x.withColumns({
        "trade": F.max(deal.cast("int")).over(g) == 1, "spent": F.sum(F.when(fiat & (F.col("change") < 0), -F.col("change")).otherwise(0)).over(g), "got": F.sum(F.when(fiat & (F.col("change") > 0), F.col("change")).otherwise(0)).over(g),
        "fiat": F.max(F.when(fiat, F.col("asset"))).over(g), "out_leg": F.min(F.when(~fiat & deal & (F.col("change") < 0), F.struct("asset", "change"))).over(g), "in_leg": F.min(F.when(~fiat & deal & (F.col("change") > 0), F.struct("asset", "change"))).over(g),
    })
    buy, q, op, stable = F.col("change") > 0, F.abs("change"), F.col("op"), S.is_stable(F.col("asset"))
    other = F.when(buy, F.col("out_leg")).otherwise(F.col("in_leg"))
    paid = F.when(buy, F.col("spent")).otherwise(F.col("got"))
    kind = (
        F.when(F.col("trade"), F.when(deal & ~fiat, F.when(buy, "BUY").otherwise("SELL"))).when(op.isin("deposit", "crypto deposit"), F.when(fiat, None).when(stable, "BUY").otherwise("TRANSFER"))
        .when(op.isin("withdraw", "crypto withdrawal"), F.when(~fiat, "TRANSFER")).when(op.isin("airdrop", "mission reward"), "AIRDROP").when(op.isin(*REWARDS), "STAKING").when(op.isin("transaction fee", "fee"), "FEE")
    )
    value = F.when(F.col("trade"), F.when(paid > 0, paid).otherwise(F.coalesce(F.abs(other["change"]), F.lit(0.0)))).when(stable & kind.isin("BUY", "STAKING", "AIRDROP"), q).otherwise(0.0)
    out = x.select(
        _content_id("xl-", "timestamp", "account", "op", "asset", "change").alias("id"), "timestamp", "asset", kind.alias("transaction_type"), q.alias("amount"), F.round(value, 2).alias("fiat_value_at_trigger"), F.lit(0.0).alias("fee_fiat"),
        F.when(F.col("trade"), F.coalesce("fiat", other["asset"])).when(stable & (value > 0), F.col("asset")).alias("fiat_currency"), "source",
        F.when(kind == "TRANSFER", F.when(op.contains("deposit"), "IN").otherwise("OUT")).alias("transfer_direction"),
    )
    return conform(out.where("transaction_type is not null and (amount > 0 or transaction_type = 'FEE')"))


def parse_woox(df: DataFrame) -> DataFrame:
    """Filled orders; PERP_BTC_USDT is a derivative of BTC in USDT."""
    status = F.upper(F.coalesce(_text(df, "status"), F.lit("")))
    done, price = number(F.col("executed")), number(F.col("average_price"))
    q, p = F.when(done > 0, done).otherwise(number(_text(df, "quantity"))), F.when(price > 0, price).otherwise(number(_text(df, "price")))
    parts = F.split(F.upper(F.trim("instrument")), "_")
    perp = parts[0] == "PERP"
    base, quote = F.when(perp, F.try_element_at(parts, F.lit(2))).otherwise(parts[0]), F.try_element_at(parts, F.lit(-1))
    side, order = F.upper(_text(df, "side")), F.nullif(F.upper(F.coalesce(_text(df, "type"), F.lit(""))), F.lit(""))
    pnl = F.when(F.lower(_text(df, "realized_pnl")).isin("", "-", "null", "nan", "none"), None).otherwise(_text(df, "realized_pnl").try_cast("double"))
    oid, token = F.nullif(_text(df, "order_id"), F.lit("")), _code(_text(df, "fee_token"))
    out = df.select(
        F.coalesce(F.concat(F.lit("woox-"), oid), _content_id("woox-", "create_time", "instrument", "side", "executed")).alias("id"), when_utc(F.col("create_time")).alias("timestamp"), base.alias("asset"),
        F.when(side == "BUY", "BUY").when((side == "SELL") | (order == "LIQUIDATE"), "SELL").alias("transaction_type"), q.alias("amount"), F.round(q * p, 2).alias("fiat_value_at_trigger"),
        F.when(S.is_stable(token) | token.isin("USD", "EUR", "GBP"), F.round(number(_text(df, "total_fee")), 8)).otherwise(0.0).alias("fee_fiat"), quote.alias("fiat_currency"), quote.alias("counter_asset"), oid.alias("trade_group_id"),
        F.lit("woox").alias("source"), F.when(perp, "perp").otherwise("spot").alias("instrument_kind"), F.when(perp, F.concat_ws(" - ", base, quote)).otherwise(F.col("instrument")).alias("instrument"), order.alias("venue_order_type"), pnl.alias("realized_pnl"),
    ).where(status.isin("", "FILLED") & (q > 0) & (p > 0))
    return conform(out.where("timestamp is not null and transaction_type is not null"))


def parse_variational(df: DataFrame) -> DataFrame:
    """Trades, or transfers whose fee rows go into the first transfer of the same time, kind and currency; fees left over stay."""
    ok = df.where(F.lower(F.coalesce(_text(df, "status"), F.lit(""))) == "confirmed")
    at = when_utc(F.col("created_at"))
    if "trade_type" in df.columns:
        q, p = number(F.col("qty")), number(F.col("price"))
        base = _code(F.col("underlying"))
        return conform(ok.select(
            F.concat(F.lit("variational-"), "id").alias("id"), at.alias("timestamp"), base.alias("asset"), F.upper(F.trim("side")).alias("transaction_type"), F.abs(q).alias("amount"), F.round(F.abs(q) * p, 2).alias("fiat_value_at_trigger"), F.lit(0.0).alias("fee_fiat"),
            F.lit("USDC").alias("fiat_currency"), F.lit("USDC").alias("counter_asset"), F.lit("variational").alias("source"), F.lit("perp").alias("instrument_kind"), F.concat_ws(" - ", base, F.lit("USDC")).alias("instrument"), F.upper("trade_type").alias("venue_order_type"),
        ).where("timestamp is not null and transaction_type in ('BUY', 'SELL')"))
    x = ok.select("id", at.alias("timestamp"), F.lower(F.trim("transfer_type")).alias("kind"), F.lower(F.coalesce(F.trim("fee_type"), F.lit(""))).alias("fee_of"), _code(F.col("asset")).alias("quote"), number(F.col("qty")).alias("q"), _code(_text(df, "underlying")).alias("underlying"))
    fees = x.where("kind = 'fee'").groupBy("timestamp", F.col("fee_of").alias("kind"), "quote").agg(F.sum(F.abs("q")).alias("fee"))
    w = Window.partitionBy("timestamp", "kind", "quote").orderBy("id")
    main = x.where("kind <> 'fee'").withColumn("n", F.row_number().over(w)).join(fees, ["timestamp", "kind", "quote"], "left").withColumn("fee", F.when(F.col("n") == 1, F.coalesce("fee", F.lit(0.0))).otherwise(0.0))
    spare = x.where("kind = 'fee'").join(x.where("kind <> 'fee'").select("timestamp", F.col("kind").alias("fee_of"), "quote").distinct(), ["timestamp", "fee_of", "quote"], "left_anti").withColumn("fee", F.abs("q"))
    k = F.col("kind")
    close = k.isin("realized_pnl", "funding")
    out = main.drop("n").unionByName(spare.select(*[c for c in main.columns if c != "n"])).select(
        F.concat(F.lit("variational-"), "id").alias("id"), "timestamp", F.when(close, F.coalesce(F.nullif("underlying", F.lit("")), F.col("quote"))).otherwise(F.col("quote")).alias("asset"),
        F.when(k.isin("deposit", "withdrawal"), "TRANSFER").when(k == "realized_pnl", "SELL").when(k.isin("funding", "fee"), "FEE").alias("transaction_type"), F.when(close | (k == "fee"), 0.0).otherwise(F.abs("q")).alias("amount"),
        F.lit(0.0).alias("fiat_value_at_trigger"), F.col("fee").alias("fee_fiat"), F.col("quote").alias("fiat_currency"), F.lit("variational").alias("source"), F.when(k == "deposit", "IN").when(k == "withdrawal", "OUT").alias("transfer_direction"),
        F.when(close, "perp").alias("instrument_kind"), k.alias("venue_order_type"), F.when(close, F.col("q")).alias("realized_pnl"),
    )
    return conform(out.where("transaction_type is not null"))


def parse_hyperliquid(fills: DataFrame) -> DataFrame:
    """Fills of the provider's JSON: coin, px, sz, side, time, tid, oid, hash, fee, feeToken, closedPnl, dir."""
    c = lambda n: F.col(n).cast("string") if n in fills.columns else F.lit(None).cast("string")
    px, sz, ms = number(c("px")), number(c("sz")), c("time").try_cast("bigint")
    coin = F.trim(c("coin"))
    spot, asset, side = F.startswith(coin, F.lit("@")), _code(F.ltrim(F.lit("@"), coin)), F.upper(F.trim(c("side")))
    out = fills.select(
        F.coalesce(F.concat(F.lit("hyperliquid-"), F.coalesce(c("tid"), c("hash"))), _content_id("hyperliquid-", c("oid"), c("time"), c("side"), c("sz"), c("px"))).alias("id"), F.timestamp_millis(ms).alias("timestamp"), asset.alias("asset"),
        F.when(side.isin("B", "BUY"), "BUY").when(side.isin("A", "S", "SELL"), "SELL").alias("transaction_type"), sz.alias("amount"), F.round(px * sz, 2).alias("fiat_value_at_trigger"),
        F.when(S.is_stable(F.coalesce(c("feeToken"), F.lit("USDC"))), F.round(F.abs(number(c("fee"))), 8)).otherwise(0.0).alias("fee_fiat"), F.lit("USD").alias("fiat_currency"), F.lit("USDC").alias("counter_asset"), c("oid").alias("trade_group_id"), F.lit("hyperliquid").alias("source"),
        F.when(spot, "spot").otherwise("perp").alias("instrument_kind"), F.when(spot, coin).otherwise(asset).alias("instrument"), F.nullif(F.trim(c("dir")), F.lit("")).alias("venue_order_type"), F.when(c("closedPnl").isin("", "0.0"), None).otherwise(c("closedPnl").try_cast("double")).alias("realized_pnl"),
    ).where((px > 0) & (sz > 0) & (ms > 0) & (F.length(coin) > 0))
    return conform(out.where("transaction_type is not null"))


def parse_bitcoin(txs: DataFrame, address: str) -> DataFrame:
    """Transactions with vin[].prevout and vout[] arrays: what the address gets beyond what it spends, by the sign a transfer in or out."""
    mine = lambda o: F.coalesce(F.lower(o["scriptpubkey_address"]) == address.strip().lower(), F.lit(False))
    total = lambda arr, part: F.coalesce(F.aggregate(F.transform(arr, lambda x: F.when(mine(part(x)), part(x)["value"].cast("bigint")).otherwise(F.lit(0).cast("bigint"))), F.lit(0).cast("bigint"), lambda a, b: a + F.coalesce(b, F.lit(0).cast("bigint"))), F.lit(0))
    net = total(F.col("vout"), lambda o: o) - total(F.col("vin"), lambda i: i["prevout"])
    way = F.when(net > 0, "IN").when(net < 0, "OUT")
    return conform(txs.where("txid is not null").select(
        F.concat(F.lit("btc-"), F.substring("txid", 1, 18), F.lit("-transfer-"), way).alias("id"), F.timestamp_seconds(F.col("status.block_time").cast("bigint")).alias("timestamp"), F.lit("BTC").alias("asset"), F.lit("TRANSFER").alias("transaction_type"),
        F.round(F.abs(net) / 1e8, 8).alias("amount"), F.lit(0.0).alias("fiat_value_at_trigger"), F.lit(0.0).alias("fee_fiat"), F.lit("bitcoin").alias("source"), way.alias("transfer_direction"), F.col("txid").alias("trade_group_id"), F.col("txid").alias("on_chain_tx_id"),
    ).where("transfer_direction is not null and timestamp is not null"))


def parse_drift(trades: DataFrame, wallet: str) -> DataFrame:
    """Fills with integer amounts: base in 1e9, quote in 1e6; the wallet's side is taker's or maker's direction."""
    c = lambda n: F.col(n).cast("string") if n in trades.columns else F.lit(None).cast("string")
    base, quote, ts = number(c("baseAssetAmountFilled")) / 1e9, number(c("quoteAssetAmountFilled")) / 1e6, c("ts").try_cast("bigint")
    taker = F.coalesce(c("taker") == wallet, F.lit(False))
    way = F.lower(F.when(taker, c("takerOrderDirection")).otherwise(c("makerOrderDirection")))
    asset = F.coalesce(F.regexp_replace(F.upper(F.nullif(F.trim(c("symbol")), F.lit(""))), "-PERP$", ""), F.concat(F.lit("MARKET-"), c("marketIndex")))
    sig = F.nullif(F.trim(c("txSig")), F.lit(""))
    out = trades.select(
        F.coalesce(F.concat(F.lit("drift-fill-"), F.nullif(F.trim(c("fillRecordId")), F.lit(""))), F.concat(F.lit("drift-"), sig, F.lit("-"), F.coalesce(c("txSigIndex"), F.lit("0"))), _content_id("drift-", c("ts"), asset, base)).alias("id"), F.timestamp_seconds(ts).alias("timestamp"),
        asset.alias("asset"), F.when(way == "long", "BUY").when(way == "short", "SELL").alias("transaction_type"), base.alias("amount"), F.round(quote, 2).alias("fiat_value_at_trigger"), F.round(F.abs(number(F.when(taker, c("takerFee")).otherwise(c("makerFee")))) / 1e6, 8).alias("fee_fiat"),
        F.lit("USD").alias("fiat_currency"), F.lit("USDC").alias("counter_asset"), F.coalesce(F.nullif(c("takerOrderId"), F.lit("")), F.nullif(c("makerOrderId"), F.lit("")), sig).alias("trade_group_id"), F.lit("drift").alias("source"), F.lit("perp").alias("instrument_kind"), sig.alias("on_chain_tx_id"),
    ).where((F.lower(F.coalesce(c("marketType"), F.lit("perp"))) == "perp") & (base > 0) & (quote > 0) & (ts > 0))
    return conform(out.where("transaction_type is not null"))


def parse_drift_funding(payments: DataFrame, markets: DataFrame | None = None) -> DataFrame:
    """Funding in 1e6 of the quote coin as fees whose result is the payment. markets: marketIndex, symbol; a market it lacks is named by its number."""
    c = lambda n: F.col(n).cast("string") if n in payments.columns else F.lit(None).cast("string")
    paid, ts = number(c("fundingPayment")) / 1e6, c("ts").try_cast("bigint")
    market, sig = F.coalesce(c("marketIndex").try_cast("bigint"), F.lit(0)), F.nullif(F.trim(c("txSig")), F.lit(""))
    symbol = F.lit(None).cast("string")
    x = payments.withColumn("_market", market)
    if markets is not None:
        known = markets.select(F.col("marketIndex").cast("string").try_cast("bigint").alias("_market"), F.upper(F.trim(F.col("symbol"))).alias("_symbol")).where("_symbol <> ''")
        x, symbol = x.join(known.groupBy("_market").agg(F.min("_symbol").alias("_symbol")), "_market", "left"), F.col("_symbol")
    asset = F.coalesce(F.regexp_replace(symbol, "-PERP$", ""), F.concat(F.lit("MARKET-"), "_market"))
    out = x.select(
        F.coalesce(F.concat(F.lit("drift-funding-"), sig, F.lit("-"), F.coalesce(c("txSigIndex"), F.lit("0"))), F.concat_ws("-", F.lit("drift-funding"), ts, "_market")).alias("id"), F.timestamp_seconds(ts).alias("timestamp"), asset.alias("asset"), F.lit("FEE").alias("transaction_type"),
        F.lit(0.0).alias("amount"), F.lit(0.0).alias("fiat_value_at_trigger"), F.round(F.abs(paid), 8).alias("fee_fiat"), F.lit("USDC").alias("fiat_currency"), F.lit("USDC").alias("counter_asset"), F.lit("drift").alias("source"), F.lit("perp").alias("instrument_kind"),
        F.lit("funding").alias("venue_order_type"), sig.alias("on_chain_tx_id"), F.round(paid, 8).alias("realized_pnl"),
    ).where((paid != 0) & (ts > 0))
    return conform(out.dropDuplicates(["id"]))


PARSERS = {"generic": parse_generic, "kraken": parse_kraken, "exchange_ledger": parse_exchange_ledger, "woox": parse_woox, "variational": parse_variational}
