"""Registered queries: searches through stored postings, held against the oracle texts of the same searches by scan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from registry.book import ORACLES, register
from registry.views import Data
from tradebook.operators.postings import Postings, open_postings, store_postings
from tradebook.operators.search import page_info, search_any
from tradebook.plans import export, reports
from tradebook.session import scratch_path


def indexed(d: Data, *tables: str) -> dict[str, Postings]:
    """Postings of whole tables, stored for this run."""
    out = {}
    for table in tables:
        path = scratch_path(d.spark, f"postings-{table}")
        store_postings(d[table], reports.SEARCHED[table], path)
        out[table] = open_postings(d.spark, path)
    return out


def _register_like(name: str, build: Callable[[Data], DataFrame]) -> None:
    register(f"{name}_postings", build)
    ORACLES[f"{name}_postings"] = ORACLES[name]


_register_like("search_any", lambda d: search_any(
    d.clients.select("id", "name", "mb", "pib"), ["name", "mb", "pib"], "r#0%12", indexed(d, "clients")["clients"]))
_register_like("list_invoices", lambda d: reports.list_invoices(
    d, "r#00000", "confirmed", page=2, limit=50, indexes=indexed(d, "invoices", "clients")))
_register_like("page_info_invoices", lambda d: page_info(reports.documents_found(
    d.invoices, d.clients, "inv-0000", "confirmed", None, *indexed(d, "invoices", "clients").values()), 3, 50))
_register_like("list_clients", lambda d: reports.list_clients(d, "00000001", 1, 100, indexes=indexed(d, "clients")))
_register_like("list_products", lambda d: reports.list_products(
    d, "bolt", "SMALL", True, 1, 50, indexes=indexed(d, "products")))
_register_like("export_clients", lambda d: export.export_clients(d, "1 doo", indexed(d, "clients")))
