"""Double-entry ledger: accounts, transfers in two phases, linked chains, limits; balances as a table.

A ledger is a serial state machine: an ordered pass in plain integers (amounts are up to
2**128 - 1).  What a transfer does depends on few of those before it, though: on those of
its id and of its pending transfer, of its chain, and of accounts whose balances matter.
So ledgers are cut into passes of bounded size where nothing else is shared, and one pass
a ledger is left for the rest.  The projection and the sums over it are ordinary frames.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

U128 = 2**128 - 1
#: Flags of accounts and transfers (fixed values of the record format).
LINKED, DEBITS_LIMITED, CREDITS_LIMITED, HISTORY, IMPORTED, CLOSED = 1, 2, 4, 8, 16, 32
PENDING, POST, VOID, BALANCING_DEBIT, BALANCING_CREDIT = 2, 4, 8, 16, 32
#: Transfers of one pass, about, where a ledger can be cut.
PASS = 20_000
#: Accounts whose amounts sum up to less can't overflow, whatever a sum of doubles rounds.
SAFE = 2.0**127


@dataclass
class Account:
    id: int
    ledger: int
    code: int
    flags: int = 0
    debits_pending: int = 0
    debits_posted: int = 0
    credits_pending: int = 0
    credits_posted: int = 0


@dataclass
class Transfer:
    id: int
    debit: int = 0
    credit: int = 0
    amount: int = 0
    ledger: int = 0
    code: int = 0
    flags: int = 0
    pending_id: int = 0
    timeout: int = 0
    timestamp: int = 0


@dataclass
class Ledger:
    accounts: dict[int, Account] = field(default_factory=dict)
    transfers: dict[int, Transfer] = field(default_factory=dict)
    resolved: dict[int, str] = field(default_factory=dict)

    # -- accounts
    def _account(self, a: Account) -> str:
        if a.id == 0:
            return "id_must_not_be_zero"
        if a.id == U128:
            return "id_must_not_be_int_max"
        if (old := self.accounts.get(a.id)) is not None:
            for what in ("flags", "ledger", "code"):
                if getattr(old, what) != getattr(a, what):
                    return f"exists_with_different_{what}"
            return "exists"
        if a.flags & DEBITS_LIMITED and a.flags & CREDITS_LIMITED:
            return "flags_are_mutually_exclusive"
        for what in ("debits_pending", "debits_posted", "credits_pending", "credits_posted"):
            if getattr(a, what):
                return f"{what}_must_be_zero"
        if a.ledger == 0:
            return "ledger_must_not_be_zero"
        if a.code == 0:
            return "code_must_not_be_zero"
        self.accounts[a.id] = replace(a)
        return "ok"

    def create_accounts(self, batch: list[Account]) -> list[str]:
        return self._chains(batch, self._account)

    # -- transfers
    def create_transfers(self, batch: list[Transfer], now: int = 0) -> list[str]:
        self.expire(now)
        return self._chains(batch, self._transfer)

    def _chains(self, batch: list, apply) -> list[str]:
        """Runs of linked events and the one that ends them stand or fall together."""
        out: list[str] = []
        at = 0
        while at < len(batch):
            end = at
            while end < len(batch) and batch[end].flags & LINKED:
                end += 1
            if end == len(batch):  # an open chain
                out += ["linked_event_failed"] * (end - at - 1) + ["linked_event_chain_open"]
                break
            end += 1
            saved = ({k: replace(v) for k, v in self.accounts.items()}, dict(self.transfers), dict(self.resolved)) if end - at > 1 else None
            codes = []
            for x in batch[at:end]:
                codes.append(why := apply(x))
                if codes[-1] != "ok" and end - at > 1:
                    self.accounts, self.transfers, self.resolved = saved
                    bad = len(codes) - 1
                    codes = ["linked_event_failed"] * (end - at)
                    codes[bad] = why
                    break
            out += codes
            at = end
        return out

    def _transfer(self, t: Transfer) -> str:
        if t.id == 0:
            return "id_must_not_be_zero"
        if t.id == U128:
            return "id_must_not_be_int_max"
        if (old := self.transfers.get(t.id)) is not None:
            for what in ("flags", "pending_id", "timeout", "debit", "credit", "amount", "ledger", "code"):
                if getattr(old, what) != getattr(t, what) and not (what == "amount" and t.flags & (POST | VOID)):
                    return f"exists_with_different_{ {'debit': 'debit_account_id', 'credit': 'credit_account_id'}.get(what, what)}"
            return "exists"
        if bin(t.flags & (PENDING | POST | VOID)).count("1") > 1 or t.flags & (POST | VOID) and t.flags & (BALANCING_DEBIT | BALANCING_CREDIT):
            return "flags_are_mutually_exclusive"
        resolving = bool(t.flags & (POST | VOID))
        if not resolving:
            for who, n in (("debit", t.debit), ("credit", t.credit)):
                if n == 0:
                    return f"{who}_account_id_must_not_be_zero"
                if n == U128:
                    return f"{who}_account_id_must_not_be_int_max"
            if t.debit == t.credit:
                return "accounts_must_be_different"
        if resolving and t.pending_id == 0:
            return "pending_id_must_not_be_zero"
        if resolving and t.pending_id == t.id:
            return "pending_id_must_be_different"
        if not resolving and t.pending_id:
            return "pending_id_must_be_zero"
        if t.timeout and not t.flags & PENDING:
            return "timeout_reserved_for_pending_transfer"
        if not resolving:
            if t.ledger == 0:
                return "ledger_must_not_be_zero"
            if t.code == 0:
                return "code_must_not_be_zero"
        return self._resolve(t) if resolving else self._regular(t)

    def _regular(self, t: Transfer) -> str:
        d, c = self.accounts.get(t.debit), self.accounts.get(t.credit)
        if d is None:
            return "debit_account_not_found"
        if c is None:
            return "credit_account_not_found"
        if d.ledger != c.ledger:
            return "accounts_must_have_the_same_ledger"
        if t.ledger != d.ledger:
            return "transfer_must_have_the_same_ledger_as_accounts"
        if d.flags & CLOSED:
            return "debit_account_already_closed"
        if c.flags & CLOSED:
            return "credit_account_already_closed"
        amount = t.amount
        if t.flags & BALANCING_DEBIT:
            amount = min(amount, max(0, d.credits_posted - d.debits_posted - d.debits_pending))
        if t.flags & BALANCING_CREDIT:
            amount = min(amount, max(0, c.debits_posted - c.credits_posted - c.credits_pending))
        if max(d.debits_pending + d.debits_posted, c.credits_pending + c.credits_posted) + amount > U128:
            return "overflows_debits" if d.debits_pending + d.debits_posted + amount > U128 else "overflows_credits"
        if d.flags & DEBITS_LIMITED and d.debits_pending + d.debits_posted + amount > d.credits_posted:
            return "exceeds_credits"
        if c.flags & CREDITS_LIMITED and c.credits_pending + c.credits_posted + amount > c.debits_posted:
            return "exceeds_debits"
        if t.flags & PENDING:
            d.debits_pending += amount
            c.credits_pending += amount
        else:
            d.debits_posted += amount
            c.credits_posted += amount
        self.transfers[t.id] = replace(t, amount=amount)
        return "ok"

    def _resolve(self, t: Transfer) -> str:
        p = self.transfers.get(t.pending_id)
        if p is None:
            return "pending_transfer_not_found"
        if not p.flags & PENDING:
            return "pending_transfer_not_pending"
        for what, name in (("debit", "debit_account_id"), ("credit", "credit_account_id"), ("ledger", "ledger"), ("code", "code")):
            if getattr(t, what) and getattr(t, what) != getattr(p, what):
                return f"pending_transfer_has_different_{name}"
        amount = p.amount if t.flags & VOID or t.amount == U128 else t.amount
        if t.flags & VOID and t.amount not in (0, p.amount):
            return "pending_transfer_has_different_amount"
        if amount > p.amount:
            return "exceeds_pending_transfer_amount"
        if p.id in self.resolved:
            return f"pending_transfer_{ {'post': 'already_posted', 'void': 'already_voided', 'expire': 'expired'}[self.resolved[p.id]]}"
        d, c = self.accounts[p.debit], self.accounts[p.credit]
        d.debits_pending -= p.amount
        c.credits_pending -= p.amount
        if t.flags & POST:
            d.debits_posted += amount
            c.credits_posted += amount
        self.resolved[p.id] = "post" if t.flags & POST else "void"
        self.transfers[t.id] = replace(t, amount=amount, debit=p.debit, credit=p.credit, ledger=p.ledger, code=p.code)
        return "ok"

    def expire(self, now: int) -> None:
        for p in list(self.transfers.values()):
            if p.flags & PENDING and p.timeout and p.id not in self.resolved and p.timestamp + p.timeout * 10**9 <= now:
                self.accounts[p.debit].debits_pending -= p.amount
                self.accounts[p.credit].credits_pending -= p.amount
                self.resolved[p.id] = "expire"


def _plain(*names: str):
    """Whether texts are digits and nothing else, so that without their leading zeros they are equal as the numbers are."""
    plain = F.lit(True)
    for n in names:
        plain = plain & F.coalesce(F.col(n).rlike("^[0-9]+$"), F.lit(False))
    return plain


def _bound(t: DataFrame) -> DataFrame:
    """(ledger, _cell) of transfers that depend on more than their cell: cells that share an id, chains, accounts whose balances matter, odd texts."""
    balancing = F.col("flags").bitwiseAND(BALANCING_DEBIT | BALANCING_CREDIT) != 0
    moves = F.when(F.col("flags").bitwiseAND(POST | VOID) == 0, F.expr("try_cast(amount as double)"))
    # accounts
    number = lambda c: F.regexp_replace(c, "^0+(?=.)", "")
    sides = t.select("ledger", "_cell", balancing.alias("b"), moves.alias("a"), F.explode(F.array(number("debit"), number("credit"))).alias("account")).where("account <> '0'")
    tight = sides.groupBy("ledger", "account").agg(F.bool_or("b").alias("b"), F.sum("a").alias("a")).where(F.col("b") | (F.col("a") >= SAFE)).select("ledger", "account")
    found = sides.join(tight, ["ledger", "account"], "left_semi").select("ledger", "_cell")
    # chains: linked transfers and those right after them
    before = F.lag("flags", 1, 0).over(Window.partitionBy("ledger").orderBy("seq", "id"))
    linked = t.where(F.col("flags").bitwiseAND(LINKED) != 0).select("ledger").distinct()
    chains = t.join(linked, "ledger", "left_semi").withColumn("_before", before)
    found = found.unionByName(chains.where(F.col("flags").bitwiseOR(F.col("_before")).bitwiseAND(LINKED) != 0).select("ledger", "_cell"))
    # ids that more than one cell names
    named = t.select("ledger", "_cell", F.explode(F.array("_id", "_pending")).alias("x")).where("x <> '0'")
    shared = named.groupBy("ledger", "x").agg(F.min("_cell").alias("lo"), F.max("_cell").alias("hi")).where("lo <> hi").select("ledger", "x")
    found = found.unionByName(named.join(shared, ["ledger", "x"], "left_semi").select("ledger", "_cell"))
    odd = t.where(~_plain("id", "pending_id", "debit", "credit", "amount")).select("ledger").distinct()
    return found.unionByName(t.join(odd, "ledger", "left_semi").select("ledger", "_cell")).distinct()


def _passes(transfers: DataFrame) -> DataFrame:
    """transfers with _pass and _of, which name their pass: numbers of passes that ledgers share, or -1 and the ledger."""
    texts = _plain("id", "pending_id", "debit", "credit", "amount")
    simple = texts & (F.col("flags").bitwiseAND(LINKED | POST | VOID | BALANCING_DEBIT | BALANCING_CREDIT) == 0) & ~F.coalesce(F.col("pending_id").rlike("[^0]"), F.lit(True))
    seen = transfers.agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.coalesce(simple, F.lit(False))).alias("simple"), F.sum(F.expr("try_cast(amount as double)")).alias("a")).first()
    number = lambda c: F.coalesce(F.regexp_replace(c, "^0+(?=.)", ""), F.lit(""))
    t = transfers.withColumns({"_id": number("id"), "_pending": number("pending_id")})
    resolving = (F.col("flags").bitwiseAND(POST | VOID) != 0) & (F.col("_pending") != "0")
    t = t.withColumn("_cell", F.when(resolving, F.col("_pending")).otherwise(F.col("_id")))
    free = F.pmod(F.xxhash64("ledger", "_cell"), F.lit(max(1, -(-seen["n"] // PASS))).cast("long"))
    if not seen["n"] or seen["simple"] and seen["a"] < SAFE:
        t = t.withColumns({"_pass": free, "_of": F.lit(0).cast("long")})
    else:
        t = t.join(_bound(t).withColumn("_bound", F.lit(True)), ["ledger", "_cell"], "left")
        t = t.withColumns({"_pass": F.when(F.col("_bound"), F.lit(-1).cast("long")).otherwise(free), "_of": F.when(F.col("_bound"), F.col("ledger")).otherwise(F.lit(0).cast("long"))})
    return t.select(*transfers.columns, "_pass", "_of")


def run(transfers: DataFrame) -> DataFrame:
    """transfers (ledger, seq, id, debit, credit, amount, code, flags, pending_id; ids and amounts as text) -> (ledger, seq, id, result).

    Accounts are those the transfers name, without flags.  In the order of seq, then id.
    """

    def one(number: int, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["seq", "id"])
        book = Ledger()
        for n in pd.unique(pd.concat([rows["debit"], rows["credit"]])):
            book.create_accounts([Account(int(n), number, 1)])
        batch = [Transfer(int(r.id), int(r.debit), int(r.credit), int(r.amount), number, int(r.code), int(r.flags), int(r.pending_id)) for r in rows.itertuples()]
        return pd.DataFrame({"ledger": rows["ledger"], "seq": rows["seq"], "id": rows["id"], "result": book.create_transfers(batch)})

    def several(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.concat([one(int(n), of) for n, of in rows.groupby("ledger", sort=False, dropna=False)])

    return _passes(transfers).groupBy("_pass", "_of").applyInPandas(several, "ledger long, seq long, id string, result string")


def balances(transfers: DataFrame, results: DataFrame | None = None) -> DataFrame:
    """(account, debits_posted, credits_posted) of posted regular transfers: plain sums, for any number of ledgers."""
    if results is not None:
        transfers = transfers.join(results.where("result = 'ok'").select("ledger", "seq"), ["ledger", "seq"], "left_semi")
    side = F.explode(F.array(F.struct(F.col("debit").alias("account"), F.col("amount").cast("decimal(38,0)").alias("d"), F.lit(0).cast("decimal(38,0)").alias("c")), F.struct(F.col("credit").alias("account"), F.lit(0).cast("decimal(38,0)").alias("d"), F.col("amount").cast("decimal(38,0)").alias("c"))))
    return transfers.where((F.col("flags").bitwiseAND(PENDING | POST | VOID)) == 0).select(side.alias("x")).groupBy("x.account").agg(F.sum("x.d").alias("debits_posted"), F.sum("x.c").alias("credits_posted"))
