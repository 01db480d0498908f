"""Change sets of clients, products, groups, users and the activity log."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradebook.functions.expressions import MONEY, initial_stock, normalized_email, trimmed
from tradebook.operators.changes import (
    Change, Ids, Tables, also, append_activity, compose, entries, inserted, invalid, not_in,
    out_of_range, rejections, removed, repeats, replaced, string_ids, system_entry, without,
)
from tradebook.operators.claims import clashes
from tradebook.operators.joins import client_usage, line_usage
from tradebook.operators.merge import first_come, one_per_key, taken
from tradebook.operators.ordered import positions
from tradebook.operators.quality import request_violations
from tradebook.operators.stock import assignable

# Fields a client update replaces, and the group fields that may be patched.
CLIENT_UPDATE = (
    "name", "legal_name", "mb", "pib", "address", "city", "municipality", "street", "house_number",
    "google_maps_link", "contact_person", "contact", "bank_info", "is_manual_address", "telegram",
    "instagram", "phone", "email", "installment_payment", "installment_term", "showcase", "bar",
    "notes",
)
CLIENT_FLAGS = ("is_manual_address", "installment_payment", "showcase", "bar")
GROUP_PATCH = (
    "name", "quantity_type", "original_quantity", "shipment_date", "reservation_type",
    "reservation_amount",
)

# The column types that numbers in requests have to fit.
CLIENT_KINDS = {"installment_term": "int"}
PRODUCT_KINDS = {"price": "decimal(10,2)", "weight": "decimal(8,2)"}
GROUP_KINDS = {"original_quantity": MONEY, "reservation_amount": MONEY}


def _tidy(requests: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Trim text fields, normalise the address."""
    tidy = {c: trimmed(c) for c in columns if c in requests.columns and c != "email"}
    if "email" in requests.columns:
        tidy["email"] = normalized_email("email")
    return requests.withColumns(tidy)


def _clients(requests: DataFrame) -> DataFrame:
    text = ("name", "legal_name", "mb", "pib", "address", "city", "municipality", "street",
            "house_number", "contact_person", "telegram", "instagram", "phone", "email", "notes")
    return _tidy(requests, text)


def _typed_clients(accepted: DataFrame) -> DataFrame:
    typed = {c: F.col(c).cast("string").try_cast("boolean") for c in CLIENT_FLAGS if c in accepted.columns}
    if "installment_term" in accepted.columns:
        typed["installment_term"] = F.col("installment_term").try_cast("int")
    return accepted.withColumns(typed)


def create_clients(t: Tables, requests: DataFrame, now: dt.datetime, ids: Ids = string_ids) -> Change:
    """New clients; refused when the mb or the pib is known or claimed earlier in the batch."""
    found = request_violations("clients", requests)
    requests = _clients(requests)
    rejected = rejections(
        ("invalid", invalid(found)), ("out_of_range", out_of_range(requests, CLIENT_KINDS)),
        ("duplicate", taken(requests, t["clients"], ["mb", "pib"])))
    passed = first_come(without(requests, rejected), ["mb", "pib"])
    rejected = also(rejected, requests, passed, "duplicate")
    accepted = _typed_clients(without(requests, rejected))
    state, rows = inserted(t["clients"], "clients", accepted, ids, now)
    log = entries(accepted.withColumn("_id", ids("clients")), F.concat(F.lit("Created client: "), "name"),
                  "client", "_id", now)
    return Change({"clients": state}, rejected, log, {"clients": rows})


def _sequenced(
    requests: DataFrame, base: DataFrame, keys: list[str], early: DataFrame, reason: str, sparse: bool = False
) -> DataFrame:
    """The verdict on updates of ``base`` taken one by one: ``early`` refusals, then a key that another row holds at
    that moment, then rows that are not there. A request for a missing row changes nothing and is checked all the same."""
    left = without(requests, early)
    known = left.join(base.select("id", F.lit(True).alias("real")), "id", "left")
    names = [r["reason"] for r in early.select("reason").distinct().collect()]  # a few fixed words
    return rejections(*_kept(early, tuple(names)), (reason, clashes(known, base, keys, sparse)), ("not_found", not_in(left, base)))


def update_clients(t: Tables, requests: DataFrame, now: dt.datetime) -> Change:
    """Full replacement by id; refused when another client holds the mb or pib at that moment.

    Requests are taken one by one: a client may be updated several times, and keys it gives up are free for
    later requests. The altered row is that of the last accepted request.
    """
    found = request_violations("clients", requests)
    requests = _clients(requests)
    early = rejections(("invalid", invalid(found)), ("out_of_range", out_of_range(requests, CLIENT_KINDS)))
    rejected = _sequenced(requests, t["clients"], ["mb", "pib"], early, "duplicate")
    accepted = _typed_clients(without(requests, rejected))
    for column in CLIENT_UPDATE:
        if column not in accepted.columns:
            accepted = accepted.withColumn(column, F.lit(None).cast("string"))
    accepted = accepted.withColumns({c: F.coalesce(F.col(c).try_cast("boolean"), F.lit(False)) for c in CLIENT_FLAGS})
    last = one_per_key(accepted, ["id"], "request_id", last=True)
    state, rows = replaced(t["clients"], "clients", last, CLIENT_UPDATE, now, keep_null=False)
    log = entries(accepted, F.concat(F.lit("Updated client: "), "name"), "client", "id", now)
    return Change({"clients": state}, rejected, log, {"clients": rows})


def _kept(rejected: DataFrame, reasons: tuple[str, ...]) -> list[tuple[str, DataFrame]]:
    return [(r, rejected.filter(F.col("reason") == r)) for r in reasons]


def delete_clients(t: Tables, requests: DataFrame, now: dt.datetime) -> Change:
    """Clients without invoices and deliveries go; ``rejected`` tells the counts of the others."""
    used = client_usage(t["clients"].select("id", "name"), t["invoices"], t["deliveries"])
    known = requests.join(used, "id")
    busy = known.filter((F.col("invoice_count") > 0) | (F.col("delivery_count") > 0))
    rejected = rejections(
        ("in_use", busy.select("request_id")), ("not_found", not_in(requests, t["clients"])),
        ("not_found", repeats(requests)))
    accepted = without(known, rejected)
    keys = accepted.select("id")
    counts = busy.select("request_id", "invoice_count", "delivery_count")
    log = entries(accepted, F.concat(F.lit("Deleted client: "), "name"), "client", "id", now)
    return Change({"clients": removed(t["clients"], keys)}, rejected.join(counts, "request_id", "left"),
                  log, gone={"clients": keys})


def _products(requests: DataFrame) -> DataFrame:
    return _tidy(requests, ("code", "name", "category", "description"))


def _typed_products(accepted: DataFrame) -> DataFrame:
    typed = {"price": F.col("price").try_cast("decimal(18,6)")}
    if "weight" in accepted.columns:
        typed["weight"] = F.col("weight").try_cast("decimal(18,6)")
    if "is_active" in accepted.columns:
        typed["is_active"] = F.col("is_active").cast("string").try_cast("boolean")
    return accepted.withColumns(typed)


def create_products(t: Tables, requests: DataFrame, now: dt.datetime, ids: Ids = string_ids) -> Change:
    """New products, always active; refused when the code is known or claimed earlier."""
    found = request_violations("products", requests)
    requests = _products(requests)
    rejected = rejections(
        ("invalid", invalid(found)), ("out_of_range", out_of_range(requests, PRODUCT_KINDS)),
        ("duplicate_code", taken(requests, t["products"], ["code"])))
    passed = first_come(without(requests, rejected), ["code"])
    rejected = also(rejected, requests, passed, "duplicate_code")
    accepted = _typed_products(without(requests, rejected)).drop("is_active")
    state, rows = inserted(t["products"], "products", accepted, ids, now)
    log = entries(accepted.withColumn("_id", ids("products")),
                  F.concat(F.lit("Created product: "), "name", F.lit(" ("), "code", F.lit(")")), "product", "_id", now)
    return Change({"products": state}, rejected, log, {"products": rows})


def update_products(t: Tables, requests: DataFrame, now: dt.datetime) -> Change:
    """Replacement by id; weight and is_active stay when absent. Taken one by one, as in ``update_clients``."""
    found = request_violations("products", requests)
    requests = _products(requests)
    early = rejections(("invalid", invalid(found)), ("out_of_range", out_of_range(requests, PRODUCT_KINDS)))
    rejected = _sequenced(requests, t["products"], ["code"], early, "duplicate_code")
    accepted = _typed_products(without(requests, rejected))
    for column in ("weight", "category", "description", "is_active"):
        if column not in accepted.columns:
            accepted = accepted.withColumn(column, F.lit(None).cast("string"))
    base = t["products"]
    kept = base.select("id", F.col("weight").alias("_weight"), F.col("is_active").alias("_active"))
    last = one_per_key(accepted, ["id"], "request_id", last=True).drop("weight", "is_active")
    patch = last.join(compose(accepted, ["weight", "is_active"]), "id").join(kept, "id").withColumns({
        "weight": F.coalesce("weight", "_weight"),
        "is_active": F.coalesce(F.col("is_active").try_cast("boolean"), "_active"),
    })
    columns = ("code", "name", "price", "weight", "category", "description", "is_active")
    state, rows = replaced(base, "products", patch, columns, now, keep_null=False)
    log = entries(accepted, F.concat(F.lit("Updated product: "), "name", F.lit(" ("), "code", F.lit(")")),
                  "product", "id", now)
    return Change({"products": state}, rejected, log, {"products": rows})


def retire_products(t: Tables, requests: DataFrame, now: dt.datetime) -> Change:
    """Products on any invoice or delivery line are deactivated, others deleted with their group
    membership."""
    used = line_usage(t["products"].select("id", "code", "name"), t["invoice_items"], t["delivery_items"])
    in_use = (F.col("invoice_usage") > 0) | (F.col("delivery_usage") > 0)
    known = requests.join(used.withColumn("_used", in_use), "id")
    rejected = rejections(
        ("not_found", not_in(requests, t["products"])),
        ("not_found", repeats(known.filter(~F.col("_used")))),
    )
    accepted = without(known, rejected)
    keys = accepted.filter(~F.col("_used")).select("id")
    patch = accepted.filter("_used").select("id").distinct().withColumn("is_active", F.lit(False))
    state, rows = replaced(t["products"], "products", patch, ["is_active"], now)
    verb = F.when(F.col("_used"), F.lit("Deactivated")).otherwise(F.lit("Deleted"))
    action = F.concat(verb, F.lit(" product: "), "name", F.lit(" ("), "code", F.lit(")"))
    return Change(
        {"products": removed(state, keys),
         "product_group_items": removed(t["product_group_items"], keys, "product_id")},
        rejected, entries(accepted, action, "product", "id", now), {"products": rows},
        gone={"products": keys},
    )


def activate_products(t: Tables, requests: DataFrame, now: dt.datetime) -> Change:
    rejected = rejections(("not_found", not_in(requests, t["products"])))
    accepted = without(requests, rejected)
    patch = accepted.select("id").distinct().withColumn("is_active", F.lit(True))
    state, rows = replaced(t["products"], "products", patch, ["is_active"], now)
    named = accepted.join(t["products"].select("id", "code", "name"), "id")
    action = F.concat(F.lit("Reactivated product: "), "name", F.lit(" ("), "code", F.lit(")"))
    return Change({"products": state}, rejected, entries(named, action, "product", "id", now), {"products": rows})


def _typed_groups(accepted: DataFrame) -> DataFrame:
    typed = {c: F.col(c).try_cast("decimal(18,6)") for c in ("original_quantity", "reservation_amount")
             if c in accepted.columns}
    if "shipment_date" in accepted.columns:
        typed["shipment_date"] = F.substring("shipment_date", 1, 10).try_cast("date")
    return accepted.withColumns(typed)


def create_groups(t: Tables, requests: DataFrame, now: dt.datetime, ids: Ids = string_ids) -> Change:
    """New groups with their opening balance."""
    requests = _tidy(requests, ("name",))
    rejected = rejections(("invalid", invalid(request_violations("product_groups", requests))),
                          ("out_of_range", out_of_range(requests, GROUP_KINDS)))
    accepted = _typed_groups(without(requests, rejected))
    if "reservation_amount" not in accepted.columns:
        accepted = accepted.withColumn("reservation_amount", F.lit(0))
    accepted = accepted.withColumns({
        "reservation_amount": F.coalesce("reservation_amount", F.lit(0).cast("decimal(18,6)")),
        "current_quantity": initial_stock("original_quantity", "reservation_amount"),
    })
    state, rows = inserted(t["product_groups"], "product_groups", accepted, ids, now)
    log = entries(accepted.withColumn("_id", ids("product_groups")), "CREATE_PRODUCT_GROUP", "product_groups", "_id",
                  now, [F.col(c) for c in ("name", "quantity_type", "original_quantity", "current_quantity",
                                           "shipment_date", "reservation_amount")])
    return Change({"product_groups": state}, rejected, log, {"product_groups": rows})


def patch_groups(t: Tables, requests: DataFrame, now: dt.datetime) -> Change:
    """Sparse patch over a fixed list of fields; the current balance is not recomputed."""
    requests = _tidy(requests, ("name",))
    columns = [c for c in GROUP_PATCH if c in requests.columns]
    blank = requests.filter(F.coalesce(*[F.col(c).cast("string") for c in columns]).isNull())
    rejected = rejections(
        ("invalid", invalid(request_violations("product_groups", requests, sparse=True))),
        ("out_of_range", out_of_range(requests, GROUP_KINDS)),
        ("no_fields", blank.select("request_id")),
        ("not_found", not_in(requests, t["product_groups"])),
    )
    accepted = _typed_groups(without(requests, rejected))
    state, rows = replaced(t["product_groups"], "product_groups", compose(accepted, columns), columns, now)
    log = entries(accepted, "UPDATE_PRODUCT_GROUP", "product_groups", "id", now, [F.col(c) for c in columns])
    return Change({"product_groups": state}, rejected, log, {"product_groups": rows})


def add_group_products(t: Tables, requests: DataFrame, now: dt.datetime, ids: Ids = string_ids) -> Change:
    """Put products into groups, as far as ``assignable`` allows."""
    judged = assignable(requests, t["product_groups"], t["products"], t["product_group_items"])
    rejected = judged.filter(F.col("reason").isNotNull()).select("request_id", "reason")
    actors = [c for c in ("actor_id", "ip_address", "user_agent") if c in requests.columns]
    accepted = judged.filter(F.col("reason").isNull()).select("request_id", "group_id", "product_id").join(
        requests.select("request_id", *actors), "request_id")
    state, rows = inserted(t["product_group_items"], "product_group_items", accepted, ids, now)
    named = accepted.join(t["products"].select(
        F.col("id").alias("product_id"), F.col("code").alias("product_code"), F.col("name").alias("product_name")),
        "product_id")
    log = entries(named, "ADD_PRODUCT_TO_GROUP", "product_groups", "group_id", now,
                  [F.col(c) for c in ("product_id", "product_code", "product_name")])
    return Change({"product_group_items": state}, rejected, log, {"product_group_items": rows})


def remove_group_products(t: Tables, requests: DataFrame, now: dt.datetime) -> Change:
    """Delete (group_id, product_id) pairs."""
    pair = ["group_id", "product_id"]
    held = t["product_group_items"].select(*pair)
    unknown = requests.join(held, pair, "left_anti").select("request_id")
    rejected = rejections(("not_in_group", unknown), ("not_in_group", repeats(requests, pair)))
    accepted = without(requests, rejected)
    state = t["product_group_items"].join(accepted.select(*pair), pair, "left_anti")
    log = entries(accepted, "REMOVE_PRODUCT_FROM_GROUP", "product_groups", "group_id", now, [F.col("product_id")])
    return Change({"product_group_items": state.select(*t["product_group_items"].columns)}, rejected, log,
                  gone={"product_group_items": accepted.select(*pair)})


def delete_groups(t: Tables, requests: DataFrame, now: dt.datetime) -> Change:
    """Groups go with their memberships."""
    base = t["product_groups"]
    rejected = rejections(("not_found", not_in(requests, base)), ("not_found", repeats(requests)))
    accepted = without(requests, rejected).join(base.select("id", "name"), "id")
    keys = accepted.select("id")
    log = entries(accepted, "DELETE_PRODUCT_GROUP", "product_groups", "id", now, [F.col("name")])
    return Change(
        {"product_groups": removed(base, keys),
         "product_group_items": removed(t["product_group_items"], keys, "group_id")},
        rejected, log, gone={"product_groups": keys},
    )


def create_users(
    t: Tables, requests: DataFrame, now: dt.datetime, ids: Ids = string_ids, by_themselves: bool = False
) -> Change:
    """New users; refused when the username or the email is known or claimed earlier.

    ``by_themselves``: they registered, and act in their own log rows.
    """
    found = request_violations("users", requests)
    if "role" in requests.columns:
        odd = requests.filter(~F.coalesce(F.col("role").isin("admin", "user"), F.lit(True)))
    else:
        odd = requests.limit(0)
    requests = _tidy(requests, ("username", "full_name", "email"))
    rejected = rejections(
        ("invalid", invalid(found)), ("invalid", odd.select("request_id")),
        ("duplicate", taken(requests, t["users"], ["username", "email"])))
    passed = first_come(without(requests, rejected), ["username", "email"])
    rejected = also(rejected, requests, passed, "duplicate")
    accepted = without(requests, rejected)
    state, rows = inserted(t["users"], "users", accepted, ids, now)
    role = F.col("role") if "role" in accepted.columns else F.lit(None).cast("string")
    made = accepted.withColumn("_id", ids("users"))
    if by_themselves:
        log = entries(made.withColumn("actor_id", F.col("_id")), "User registered", "user", "_id", now)
    else:
        log = entries(made, "User created", "user", "_id", now,
                      [F.col("username").alias("created_username"), F.coalesce(role, F.lit("user")).alias("role")])
    return Change({"users": state}, rejected, log, {"users": rows})


def patch_users(t: Tables, requests: DataFrame, now: dt.datetime) -> Change:
    """Sparse patch of email and full_name; permissions are replaced whole when given.

    An address that another user has at that moment is refused; one that was given up earlier in the batch is free.
    """
    columns = [c for c in ("email", "full_name", "permissions") if c in requests.columns]
    rejected = rejections(
        ("no_fields", requests.filter(F.coalesce(*columns).isNull()).select("request_id")), ("not_found", not_in(requests, t["users"])))
    if "email" in columns:
        rejected = _sequenced(requests, t["users"], ["email"], rejected, "duplicate", sparse=True)
    accepted = without(requests, rejected)
    state, rows = replaced(t["users"], "users", compose(accepted, columns), columns, now)
    fields = [F.col(c) for c in ("email", "full_name") if c in columns]
    log = entries(accepted.filter(F.coalesce(*fields).isNotNull()) if fields else accepted.limit(0),
                  "Profile updated", "user", "id", now)
    if "permissions" in columns:
        named = t["users"].select("id", F.col("username").alias("target_username"))
        allowed = accepted.filter(F.col("permissions").isNotNull()).join(named, "id")
        log = log.unionByName(entries(allowed, "User permissions updated", "user", "id", now, [
            F.col("target_username"), F.try_parse_json("permissions").alias("new_permissions")]))
    return Change({"users": state}, rejected, log, {"users": rows})


def _own(requests: DataFrame) -> DataFrame:
    """Ids of requests that aim at the actor's own account."""
    if "actor_id" not in requests.columns:
        return requests.select("request_id").limit(0)
    return requests.filter(F.col("id") == F.col("actor_id")).select("request_id")


def toggle_users(t: Tables, requests: DataFrame, now: dt.datetime) -> Change:
    """Flip is_active; an even number of flips of one user in a batch leaves it as it was."""
    rejected = rejections(("own_account", _own(requests)), ("not_found", not_in(requests, t["users"])))
    accepted = without(requests, rejected)
    flips = accepted.groupBy("id").agg((F.count(F.lit(1)) % 2 == 1).alias("_odd"))
    flag = t["users"].select("id", "is_active")
    patch = flips.join(flag, "id").select(
        "id", F.when(F.col("_odd"), ~F.col("is_active")).otherwise(F.col("is_active")).alias("is_active"))
    state, rows = replaced(t["users"], "users", patch, ["is_active"], now)
    nth = positions(accepted, ["id"], ["request_id"], "_nth").join(t["users"].select("id", "username", "is_active"), "id")
    flipped = F.when(F.col("_nth") % 2 == 1, ~F.col("is_active")).otherwise(F.col("is_active"))
    named = nth.withColumn("new_status", flipped)
    verb = F.when(F.col("new_status"), F.lit("User activated")).otherwise(F.lit("User deactivated"))
    log = entries(named, verb, "user", "id", now, [F.col("username").alias("target_username"), F.col("new_status")])
    return Change({"users": state}, rejected, log, {"users": rows})


def delete_users(t: Tables, requests: DataFrame, now: dt.datetime) -> Change:
    """Users go unless it is one's own account or rows of other tables still name them."""
    named = [t["activity_logs"].select(F.col("user_id").alias("id"))] if "activity_logs" in t else []
    named += [t[n].select(F.col("created_by").alias("id"))
              for n in ("clients", "products", "invoices", "deliveries", "product_groups")
              if n in t and "created_by" in t[n].columns]
    busy = requests.limit(0).select("request_id")
    for ids in named:
        used = ids.filter("id IS NOT NULL").distinct()
        busy = busy.unionByName(requests.join(used, "id", "left_semi").select("request_id"))
    rejected = rejections(
        ("own_account", _own(requests)), ("not_found", not_in(requests, t["users"])),
        ("in_use", busy), ("not_found", repeats(requests)))
    accepted = without(requests, rejected).join(t["users"].select("id", "username"), "id")
    keys = accepted.select("id")
    log = entries(accepted, "User deleted", "user", "id", now, [F.col("username").alias("deleted_username")])
    return Change({"users": removed(t["users"], keys)}, rejected, log, gone={"users": keys})


def cleanup_logs(
    logs: DataFrame, now: dt.datetime, days: int = 90, ids: Ids | None = None
) -> Change:
    """Keep rows of the last ``days`` days and add a system row telling how many went."""
    if not 1 <= days <= 365:
        raise ValueError("days must be between 1 and 365")
    cutoff = now - dt.timedelta(days=days)
    old = F.col("created_at") < F.lit(cutoff)
    kept = logs.filter(F.col("created_at").isNull() | ~old)
    gone = logs.filter(old).agg(F.count(F.lit(1)).alias("deletedCount")).withColumn("request_id", F.lit(0).cast("long"))
    log = system_entry(gone, "CLEANUP_OLD_LOGS", "activity_logs", now, [
        F.lit(days).alias("daysToKeep"), F.col("deletedCount"),
        F.lit(cutoff.isoformat(timespec="milliseconds") + "Z").alias("cutoffDate")])
    rejected = gone.select("request_id", F.lit(None).cast("string").alias("reason")).limit(0)
    return Change({"activity_logs": append_activity(kept, log, ids)}, rejected, log,
                  rows={"deleted": gone.select("deletedCount")})
