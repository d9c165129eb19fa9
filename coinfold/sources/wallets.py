"""Wallet exports, chain payloads, an app's export and pasted e-mail text as ledger rows."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators.ledger_ops import is_spam
from .exports import _code, _content_id, _map, _text, is_fiat
from .files import number, when_utc
from .testdata import conform

# Transaction kinds of the app's export.
EXCHANGE = ("crypto_exchange", "crypto_viban_exchange", "trading", "trade")
SWAPS = ("crypto_wallet_swap_credited", "crypto_wallet_swap_debited")
APP_KINDS = {
    "BUY": ("crypto_purchase", "viban_purchase", "buy", "crypto_buy", "crypto_wallet_swap_credited", "recurring_buy"), "SELL": ("crypto_sale", "crypto_sold", "sell", "crypto_sell", "crypto_wallet_swap_debited"),
    "IN": ("crypto_deposit", "crypto_transfer_in", "crypto_earn_program_withdrawn", "transfer_in", "deposit"), "OUT": ("crypto_withdrawal", "crypto_transfer_out", "crypto_earn_program_created", "crypto_earn_program_deposit", "transfer_out", "withdrawal"),
    "STAKING": ("crypto_earn_interest_paid", "interest", "mco_stake_reward", "supercharger_reward", "reward"), "AIRDROP": ("admin_wallet_credited", "referral_bonus", "referral_gift", "referral_card_cashback", "reimbursement", "airdrop"),
    "FEE": ("crypto_withdrawal_fee", "fee", "admin_wallet_debited"),
}
# Message types and micro-denominations of Cosmos chains.
COSMOS_REWARD, COSMOS_OUT, COSMOS_IN = ("getreward", "withdrawrewards", "withdrawreward", "claimrewards", "claim"), ("delegate", "beginredelegate", "redelegate"), ("undelegate", "unbond", "cancelundelegate")
COSMOS_SEND, COSMOS_RECEIVE = ("send", "ibcsend", "msgsend", "withdraw", "withdrawal"), ("receive", "ibcrecv", "ibcreceive", "deposit", "recv")
DENOMS = {"utia": "TIA", "uosmo": "OSMO", "uatom": "ATOM", "ujuno": "JUNO", "udvpn": "DVPN", "uakt": "AKT", "uxprt": "XPRT", "unibi": "NIBI", "udym": "DYM", "uinj": "INJ", "uscrt": "SCRT", "ustars": "STARS", "ukava": "KAVA", "uluna": "LUNA", "uaxl": "AXL"}


def parse_cryptocom(df: DataFrame) -> DataFrame:
    """The kind, or else the description, says what a row is; of exchanges, the sign does. Cash legs in stablecoins are left out,
    except in pairs of swap rows of one time, which become a sale and a purchase that name each other."""
    kind, desc = F.lower(_text(df, "transaction_kind")), F.lower(F.coalesce(_text(df, "transaction_description"), F.lit("")))
    x = df.select(
        when_utc(F.col("timestamp_utc")).alias("timestamp"), F.coalesce(kind, F.lit("")).alias("kind"), desc.alias("d"), F.upper(_text(df, "currency")).alias("asset"), number(F.col("amount")).alias("a"), F.upper(_text(df, "to_currency")).alias("to_asset"),
        number(_text(df, "to_amount")).alias("to_a"), number(_text(df, "native_amount")).alias("native"), F.upper(_text(df, "native_currency")).alias("native_ccy"), number(_text(df, "native_amount_in_usd")).alias("usd"), F.nullif(_text(df, "transaction_hash"), F.lit("")).alias("hash"),
    ).where("timestamp is not null and a <> 0")
    w = Window.partitionBy("timestamp")
    swap = F.col("kind").isin(*SWAPS)
    x = x.withColumns({"pair": swap & (F.sum(swap.cast("int")).over(w) >= 2), "debit": F.min(F.when(swap & (F.col("a") < 0), F.struct("asset", "a", "native", "native_ccy", "usd"))).over(w), "credit": F.min(F.when(swap & (F.col("a") > 0), F.struct("asset", "a", "native", "native_ccy", "usd"))).over(w)})
    k, d, a = F.col("kind"), F.col("d"), F.col("a")
    t = F.when(k.isin(*EXCHANGE), F.when(a < 0, "SELL").otherwise("BUY"))
    for name in ("BUY", "SELL", "IN", "OUT", "STAKING"):
        t = t.when(k.isin(*APP_KINDS[name]), name)
    t = t.when(k.isin(*APP_KINDS["AIRDROP"]) | d.contains("adjustment (credit)"), "AIRDROP").when(k.isin(*APP_KINDS["FEE"]) | d.contains("fee"), "FEE")
    t = t.when(d.contains("earn withdrawal") | (d.contains("deposit") & (a > 0)), "IN").when(d.contains("withdraw") & (a < 0), "OUT").when(d.contains("balance conversion"), F.when(a < 0, "SELL").otherwise("BUY"))
    t = t.when(d.contains("buy ") | d.contains("purchase"), "BUY").when(d.contains("sell ") | d.contains("sold"), "SELL")
    t = F.when(F.col("pair"), F.when(a < 0, "SELL").otherwise("BUY")).otherwise(t)
    other = F.when(F.col("pair"), F.when(a < 0, F.col("credit")).otherwise(F.col("debit")))
    cash = S.is_stable(F.col("asset")) & t.isin("BUY", "SELL") & ~F.col("pair")
    own = F.when((F.col("native") > 0) & (F.col("native_ccy") != ""), F.struct(F.col("native").alias("v"), F.col("native_ccy").alias("c"))).when(F.col("usd") > 0, F.struct(F.col("usd").alias("v"), F.lit("USD").alias("c")))
    lent = F.when((other["native"] > 0) & (other["native_ccy"] != ""), F.struct(other["native"].alias("v"), other["native_ccy"].alias("c"))).when(other["usd"] > 0, F.struct(other["usd"].alias("v"), F.lit("USD").alias("c")))
    v = F.coalesce(own, F.when(F.col("pair") & (a < 0), lent))
    to = (F.col("to_asset") != "") & (F.col("to_a") > 0) & ~is_fiat(F.col("to_asset"))
    out = x.withColumns({"t": t, "v": v}).where(~cash & ~is_fiat(F.col("asset"))).select(
        F.concat_ws("-", F.lit("cdc"), F.coalesce(F.substring("hash", 1, 24), F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss")), "kind", "asset").alias("id"), "timestamp", "asset", F.when(F.col("t").isin("IN", "OUT"), "TRANSFER").otherwise(F.col("t")).alias("transaction_type"), F.abs("a").alias("amount"),
        F.when(F.coalesce("v.v", F.lit(0.0)) >= 1, F.round("v.v", 2)).otherwise(F.round(F.coalesce("v.v", F.lit(0.0)), 6)).alias("fiat_value_at_trigger"), F.lit(0.0).alias("fee_fiat"), F.col("v.c").alias("fiat_currency"), F.coalesce(other["asset"], F.when(to, F.col("to_asset"))).alias("counter_asset"),
        F.coalesce(F.abs(other["a"]), F.when(to, F.col("to_a"))).alias("counter_amount"), F.lit("cryptocom").alias("source"), F.when(F.col("t").isin("IN", "OUT"), F.col("t")).alias("transfer_direction"), F.when(F.startswith("hash", F.lit("0x")) & (F.length("hash") >= 42), F.col("hash")).alias("on_chain_tx_id"),
    )
    one = Window.partitionBy("id").orderBy("timestamp", "amount")
    return conform(out.where("transaction_type is not null").withColumn("_n", F.row_number().over(one)).where("_n = 1"))


def parse_evm(rows: DataFrame, chain: str) -> DataFrame:
    """Normalised transfers (hash, timestamp, kind, flow, asset, amount, contract, counterparty): one leg is a transfer, several are
    netted by asset to sales and purchases, or transfers in if nothing left the wallet. Fees are rows of kind fee; scam labels are left out."""
    legs = rows.where("coalesce(kind, '') <> 'fee' and hash is not null and hash <> ''")
    signed = F.when(F.col("flow") == "in", F.col("amount")).otherwise(-F.col("amount"))
    size = legs.groupBy("hash").agg(F.count("*").alias("n_legs"), F.min("timestamp").alias("at"))
    net = legs.groupBy("hash", "asset").agg(F.sum(signed).alias("net"), F.max("contract").alias("contract"), F.max("counterparty").alias("counterparty")).join(size, "hash").where("abs(net) > 1e-12 or n_legs = 1")
    w = Window.partitionBy("hash")
    ins, outs = F.count_if(F.col("net") > 0).over(w), F.count_if(F.col("net") < 0).over(w)
    only_in, only_out = F.max(F.when(F.col("net") > 0, F.col("asset"))).over(w), F.max(F.when(F.col("net") < 0, F.col("asset"))).over(w)
    moved = (F.col("n_legs") == 1) | (F.col("outs") == 0)
    x = net.withColumns({"ins": ins, "outs": outs, "in_asset": only_in, "out_asset": only_out}).where(~is_spam(F.col("asset")))
    side = F.when(F.col("net") > 0, "buy").otherwise("sell")
    way = F.when(F.col("net") > 0, "IN").otherwise("OUT")
    out = x.select(
        F.concat_ws("-", F.lit(chain), F.substring("hash", 1, 18), F.when(moved, F.concat(F.lit("transfer-"), way)).otherwise(side), "asset").alias("id"), F.col("at").alias("timestamp"), "asset", F.when(moved, "TRANSFER").otherwise(F.upper(side)).alias("transaction_type"), F.abs("net").alias("amount"),
        F.lit(0.0).alias("fiat_value_at_trigger"), F.lit(0.0).alias("fee_fiat"), F.lit(chain).alias("source"), F.when(moved, way).alias("transfer_direction"), F.when(~moved, F.when((F.col("net") > 0) & (F.col("outs") == 1), F.col("out_asset")).when((F.col("net") < 0) & (F.col("ins") == 1), F.col("in_asset"))).alias("counter_asset"),
        F.when(moved, F.col("counterparty")).alias("counterparty_address"), F.col("hash").alias("trade_group_id"), F.col("hash").alias("on_chain_tx_id"), F.col("contract").alias("token_mint"),
    )
    fees = rows.where("kind = 'fee' and amount > 0").groupBy("hash").agg(F.max(F.struct("timestamp", "asset", "amount")).alias("f")).select(
        F.concat_ws("-", F.lit(chain), F.substring("hash", 1, 18), F.lit("fee")).alias("id"), "f.timestamp", "f.asset", F.lit("FEE").alias("transaction_type"), "f.amount", F.lit(0.0).alias("fiat_value_at_trigger"), F.lit(0.0).alias("fee_fiat"), F.lit(chain).alias("source"), F.col("hash").alias("trade_group_id"), F.col("hash").alias("on_chain_tx_id")
    )
    return conform(out.unionByName(fees, allowMissingColumns=True))


def evm_export_rows(df: DataFrame, filename: str = "") -> DataFrame:
    """An explorer's export as the normalised transfers of `parse_evm`; rows without hash, time or amount, and of others, are left out.

    The wallet is the address in the file's name, or else the one that stands most often in the from and to columns
    (of equals the least).
    """
    field = lambda *names: F.coalesce(*[F.when(~F.lower(_text(df, n)).isin("", "nan"), _text(df, n)) for n in names])
    amounts = [number(_text(df, n)) for n in ("amount", "value_in_eth", "value_out_eth", "value_eth", "value")]
    times = []
    for n in ("datetime_utc", "human_time", "block_time", "unixtimestamp", "unix_timestamp", "timestamp", "date"):
        seconds = _text(df, n).try_cast("double").try_cast("bigint")
        times += [F.when(seconds.isNull(), when_utc(_text(df, n))), F.when(seconds > 0, F.timestamp_seconds(seconds))]
    contract = field("contractaddress", "token_address", "contract_address")
    x = df.select(
        field("transaction_hash", "txhash", "hash", "trans_id").alias("hash"), F.coalesce(*times).alias("timestamp"), F.lower(field("from", "from_address")).alias("a"), F.lower(field("to", "to_address")).alias("b"), F.coalesce(*[F.when(c > 0, c) for c in amounts]).alias("amount"),
        F.coalesce(F.upper(field("token_symbol", "token", "asset", "symbol")), F.when(contract.isNotNull(), "UNKNOWN"), F.lit("ETH")).alias("asset"), contract.alias("contract"),
    )
    named = re.search("0x[0-9a-f]{40}", filename.lower())
    if named:
        wallet = named[0]
    else:
        seen = x.select(F.explode(F.array("a", "b")).alias("w")).where("w rlike '^0x[0-9a-f]{40}$'").groupBy("w").agg(F.count("*").alias("n"))
        wallet = seen.agg(F.max_by("w", F.struct("n", F.translate("w", "0123456789abcdef", "fedcba9876543210")))).first()[0]  # one value
    if wallet is None:
        raise ValueError("no wallet address in the file's name or its from and to columns")
    flow = F.when(F.col("a") == wallet, "out").when(F.col("b") == wallet, "in")
    y = x.withColumns({"flow": flow, "kind": F.when(F.col("contract").isNull(), "native").otherwise("token"), "counterparty": F.when(flow == "out", F.col("b")).otherwise(F.col("a"))})
    return y.where("hash is not null and timestamp is not null and amount > 0 and flow is not null").select("hash", "timestamp", "kind", "flow", "asset", "amount", "contract", "counterparty")


def parse_evm_csv(df: DataFrame, filename: str = "", chain: str = "ethereum") -> DataFrame:
    return parse_evm(evm_export_rows(df, filename), chain)


def parse_cosmos(df: DataFrame) -> DataFrame:
    """Messages by type. The wallet is the address that most messages speak for; it corrects the direction of transfers. Swaps are left out."""
    kind = F.regexp_replace(F.lower(_text(df, "type")), "[ _]", "")
    token, denom = F.upper(F.nullif(_text(df, "token"), F.lit(""))), F.lower(F.coalesce(_text(df, "denom"), F.lit("")))
    asset = F.coalesce(F.when(token != "NAN", token), _map(DENOMS, denom), F.when(F.startswith(denom, F.lit("u")) & (F.length(denom) > 1), F.upper(F.substring(denom, 2, 99))), F.upper(denom))
    price = lambda *names: F.coalesce(*[F.nullif(number(_text(df, n)), F.lit(0.0)) for n in names], F.lit(0.0))
    x = df.select(
        kind.alias("kind"), asset.alias("asset"), number(F.col("amount")).alias("amount"), when_utc(F.col("timestamp")).alias("timestamp"), _text(df, "from").alias("a"), _text(df, "to").alias("b"), _text(df, "txhash").alias("hash"), F.coalesce(_text(df, "index"), F.lit("")).alias("i"),
        price("totalprice", "total_price").alias("total"), price("unitprice", "unit_price").alias("unit"),
    ).where("amount > 0 and timestamp is not null")
    k = F.col("kind")
    speaks = F.when(k.isin(*COSMOS_OUT, *COSMOS_SEND), F.col("a")).when(k.isin(*COSMOS_REWARD, *COSMOS_RECEIVE, *COSMOS_IN), F.col("b"))
    wallet = x.select(speaks.alias("wallet")).where("wallet <> '' and not contains(wallet, 'valoper')").groupBy("wallet").agg(F.count("*").alias("n")).agg(F.max_by("wallet", F.struct("n", "wallet")).alias("wallet")).first().wallet  # one value
    chains = [(F.lower(c).startswith(p), n) for c in (F.col("a"), F.col("b")) for p, n in (("celestia", "celestia"), ("osmo", "osmosis"), ("cosmos", "cosmos"))]
    source = F.coalesce(*[F.when(c, n) for c, n in chains], F.lit("cosmos"))
    way = F.when(k.isin(*COSMOS_OUT, *COSMOS_SEND), "OUT").when(k.isin(*COSMOS_IN, *COSMOS_RECEIVE), "IN")
    value = F.when(k.isin(*COSMOS_REWARD), F.when(F.col("total") > 0, F.col("total")).otherwise(F.col("amount") * F.col("unit"))).when(k.isin(*COSMOS_RECEIVE), F.col("total")).otherwise(0.0)
    y = x.withColumns({"way": way, "value": value, "wallet": F.lit(wallet)})
    out = y.select(
        F.concat_ws("-", F.when(F.col("i") != "", F.concat_ws("-", F.substring("hash", 1, 16), "i")).otherwise(F.col("hash")), "kind", "asset").alias("id"), "timestamp", "asset", F.when(k.isin(*COSMOS_REWARD), "STAKING").when(F.col("way").isNotNull(), "TRANSFER").alias("transaction_type"), "amount",
        F.round("value", 2).alias("fiat_value_at_trigger"), F.lit(0.0).alias("fee_fiat"), F.when(F.col("value") > 0, "USD").alias("fiat_currency"), source.alias("source"),
        F.when(F.col("way").isNotNull(), F.when((F.col("a") == F.col("wallet")) & (F.col("way") != "IN"), "OUT").when((F.col("b") == F.col("wallet")) & (F.col("way") != "OUT"), "IN").otherwise(F.col("way"))).alias("transfer_direction"),
    )
    return conform(out.where("transaction_type is not null"))


def _found(block: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.trim(F.regexp_extract(block, "(?i)" + pattern, group)), F.lit(""))


def parse_emails(texts: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """(ledger rows, notes) of pasted e-mail text: fiat deposits are purchases, withdrawals transfers out (their time is UTC+8);
    fills of derivatives tell no result and are only noted."""
    start = r"(?i)(?=(?:Payment ID:|Withdrawal Amount:|Your\s+[A-Z0-9]+_USDT\s+futures))"
    b = texts.select(F.explode(F.split(F.regexp_replace(F.col(column), r"[\r‎‏​‌‍﻿⁠]", ""), start)).alias("b")).where("trim(b) <> ''")
    plain = lambda c: F.regexp_replace(c, ",", "").try_cast("double")
    c = F.col("b")
    deposit = b.select(
        _found(c, r"Payment ID:\s*(\S+)").alias("pid"), plain(_found(c, r"Deposit Fiat Amount:\s*([\d,.]+)")).alias("fiat"), F.upper(_found(c, r"Deposit Fiat Amount:\s*[\d,.]+\s*([A-Za-z]{3,10})")).alias("ccy"), plain(_found(c, r"Received Crypto:\s*([\d,.]+)")).alias("q"),
        _code(_found(c, r"Received Crypto:\s*[\d,.]+\s*([A-Za-z0-9]+)")).alias("asset"), F.substring(_found(c, r"Deposit Date:\s*([0-9]{4}-[0-9]{2}-[0-9]{2}[ T][0-9:]+)"), 1, 19).alias("at"), plain(_found(c, r"Processing Fee:\s*([\d,.]+)")).alias("fee"), F.upper(_found(c, r"Processing Fee:\s*[\d,.]+\s*([A-Za-z]{3,10})")).alias("fee_ccy"),
    ).where("pid is not null and fiat is not null and q > 0")
    fee = F.coalesce("fee", F.lit(0.0))
    imputed = F.when(F.col("fee_ccy").isin("USDT", "USDC", "USD") | (F.col("fee_ccy") == F.col("asset")), F.when(F.col("fee_ccy") != F.col("ccy"), fee * F.col("fiat") / F.col("q")))
    bought = deposit.select(
        F.concat(F.lit("mexc-deposit-"), "pid").alias("id"), when_utc(F.col("at")).alias("timestamp"), "asset", F.lit("BUY").alias("transaction_type"), F.col("q").alias("amount"), F.round("fiat", 2).alias("fiat_value_at_trigger"), F.round(F.coalesce(imputed, fee), 8).alias("fee_fiat"), F.col("ccy").alias("fiat_currency"),
        F.col("ccy").alias("counter_asset"), F.col("fiat").alias("counter_amount"), F.lit("mexc").alias("source"), F.col("pid").alias("trade_group_id"), F.lit("fiat_deposit").alias("venue_order_type"),
    )
    tx = _found(c, r"TxID:\s*(\S+)")
    sent = b.select(
        F.coalesce(F.concat(F.lit("mexc-withdraw-"), tx), _content_id("mexc-withdraw-", c)).alias("id"), (when_utc(F.substring(_found(c, r"Withdrawal Time:\s*([0-9]{4}-[0-9]{2}-[0-9]{2}[ T][0-9:]+)"), 1, 19)) - F.expr("interval 8 hours")).alias("timestamp"), _code(_found(c, r"Withdrawal Amount:\s*[\d,.]+\s+([A-Za-z0-9]+)")).alias("asset"),
        F.lit("TRANSFER").alias("transaction_type"), plain(_found(c, r"Withdrawal Amount:\s*([\d,.]+)")).alias("amount"), F.lit(0.0).alias("fiat_value_at_trigger"), F.lit(0.0).alias("fee_fiat"), F.lit("mexc").alias("source"), F.lit("OUT").alias("transfer_direction"),
        _found(c, r"Withdrawal Address:\s*(\S+)").alias("counterparty_address"), tx.alias("on_chain_tx_id"), tx.alias("trade_group_id"), F.lit("withdrawal").alias("venue_order_type"),
    )
    notes = b.where(c.rlike(r"(?i)Your\s+[A-Z0-9]+_USDT\s+futures")).select(F.concat_ws(" ", F.lit("skipped: a fill without entry price and result of"), _found(c, r"Your\s+([A-Z0-9]+)_USDT\s+futures")).alias("note"))
    ok = "timestamp is not null and amount > 0 and asset is not null"
    return conform(bought.unionByName(sent, allowMissingColumns=True).where(ok)), notes


def parse_cardano(txs: DataFrame, address: str) -> DataFrame:
    """Transactions with inputs[] and outputs[] of (payment, stake, value in lovelace): the net of what is the address's."""
    mine = lambda o: F.coalesce((o["payment"] == address) | (o["stake"] == address), F.lit(False))
    total = lambda arr: F.coalesce(F.aggregate(F.filter(arr, mine), F.lit(0).cast("bigint"), lambda s, o: s + F.coalesce(o["value"].cast("bigint"), F.lit(0).cast("bigint"))), F.lit(0))
    net = total(F.col("outputs")) - total(F.col("inputs"))
    way = F.when(net > 0, "IN").when(net < 0, "OUT")
    return conform(txs.select(
        F.concat(F.lit("ada-"), F.substring("tx_hash", 1, 18), F.lit("-transfer-"), way).alias("id"), F.timestamp_seconds(F.col("tx_timestamp").cast("bigint")).alias("timestamp"), F.lit("ADA").alias("asset"), F.lit("TRANSFER").alias("transaction_type"), F.round(F.abs(net) / 1e6, 6).alias("amount"),
        F.lit(0.0).alias("fiat_value_at_trigger"), F.lit(0.0).alias("fee_fiat"), F.lit("cardano").alias("source"), way.alias("transfer_direction"), F.col("tx_hash").alias("trade_group_id"), F.col("tx_hash").alias("on_chain_tx_id"),
    ).where("transfer_direction is not null and timestamp is not null"))


def parse_celestia(txs: DataFrame, address: str) -> DataFrame:
    """Transactions (txhash, timestamp, events[] of type and attributes[] of key and value): transfers of "123utia" from or to the address, each hash once."""
    e = txs.dropDuplicates(["txhash"]).select("txhash", when_utc(F.col("timestamp")).alias("timestamp"), F.posexplode("events").alias("n", "e")).where("e.type = 'transfer'")
    value = lambda key: F.get(F.transform(F.filter("e.attributes", lambda a: a["key"] == key), lambda a: a["value"]), F.lit(0))
    x = e.select("txhash", "timestamp", "n", value("sender").alias("a"), value("recipient").alias("b"), (F.regexp_extract(F.coalesce(value("amount"), F.lit("")), r"^(\d+)utia", 1).try_cast("double") / 1e6).alias("q"))
    way = F.when(F.col("b") == address, "IN").when(F.col("a") == address, "OUT")
    return conform(x.select(
        F.concat_ws("-", F.lit("tia"), F.substring("txhash", 1, 18), "n", way).alias("id"), "timestamp", F.lit("TIA").alias("asset"), F.lit("TRANSFER").alias("transaction_type"), F.col("q").alias("amount"), F.lit(0.0).alias("fiat_value_at_trigger"), F.lit(0.0).alias("fee_fiat"), F.lit("celestia").alias("source"),
        way.alias("transfer_direction"), F.when(way == "IN", F.col("a")).otherwise(F.col("b")).alias("counterparty_address"), F.col("txhash").alias("trade_group_id"), F.col("txhash").alias("on_chain_tx_id"),
    ).where("transfer_direction is not null and amount > 0 and timestamp is not null"))
