"""Queries over balances, availability and item status."""

from __future__ import annotations

from pyspark.sql import functions as F

from kitlend.operators import balances as B
from kitlend.plans.catalog import register
from kitlend.plans.oracle_fixtures import AS_OF_SQL, with_fixtures
from kitlend.sources.fixtures import AS_OF, lending

# Shared CTEs: what came back is summed once per loan, and each loan carries it.
BLOCKS = {
    "_back": "SELECT transaction_id AS loan, SUM(return_qty)::BIGINT AS units FROM transaction_returns GROUP BY ALL",
    "_ledger": """
  SELECT x.*, COALESCE(_back.units, 0) AS came_back, x.qty::BIGINT - COALESCE(_back.units, 0) AS missing
  FROM transactions x LEFT JOIN _back ON _back.loan = x.id""",
    "_running": "SELECT * FROM _ledger WHERE return_date IS NULL",
    "_still_out": """
  SELECT r.id AS tx_id, r.user_id, r.inventory_id, inv.item_name, r.borrow_date, r.promised_return_date,
         r.qty AS borrowed_qty, r.came_back AS returned_qty, r.missing AS outstanding_qty
  FROM _running r JOIN inventory inv ON r.inventory_id = inv.id WHERE r.missing > 0""",
    "_item_units": """
  SELECT inv.id, inv.item_name, inv.stock AS physical_stock, u.used AS outstanding_in_use,
         GREATEST(inv.stock - u.used, 0)::BIGINT AS available_for_new_borrow, inv.active
  FROM inventory inv, LATERAL (SELECT COALESCE(SUM(outstanding_qty), 0)::BIGINT AS used
                               FROM _still_out s WHERE s.inventory_id = inv.id) u""",
}


def oracle(body: str, extra: dict[str, str] | None = None, recursive: bool = False) -> str:
    return with_fixtures(body, {**BLOCKS, **(extra or {})}, recursive)


@register("tx_outstanding", oracle("SELECT * FROM _still_out"))
def q_tx_outstanding(spark, sf_dir):
    return B.tx_outstanding(lending(spark, sf_dir))


@register("inventory_available", oracle("SELECT * FROM _item_units"))
def q_inventory_available(spark, sf_dir):
    return B.inventory_available(lending(spark, sf_dir))


ITEM_STATUS_SQL = oracle(f"""
SELECT inv.id, inv.item_name, inv.stock AS stock_total, n.used AS in_use, n.late AS overdue_2_6,
       n.very_late AS overdue_7_plus, GREATEST(inv.stock - n.used, 0) AS available
FROM inventory inv, LATERAL (
  SELECT COALESCE(SUM(missing) FILTER (WHERE missing > 0), 0)::INTEGER AS used,
         COALESCE(SUM(qty) FILTER (WHERE age >= 2 AND age < 7), 0)::INTEGER AS late,
         COALESCE(SUM(qty) FILTER (WHERE age >= 7), 0)::INTEGER AS very_late
  FROM (SELECT *, {AS_OF_SQL} - borrow_date AS age FROM _running) r WHERE r.inventory_id = inv.id) n
WHERE inv.active AND inv.deleted_at IS NULL""")


@register("item_status", ITEM_STATUS_SQL)
def q_item_status(spark, sf_dir):
    return B.item_status(lending(spark, sf_dir), AS_OF)


@register("stock_level", oracle("""
SELECT id, item_name, available_for_new_borrow,
       CASE WHEN available_for_new_borrow = 0 THEN 'out'
            WHEN available_for_new_borrow <= 2 THEN 'low' ELSE 'ok' END AS stock_level
FROM _item_units"""))
def q_stock_level(spark, sf_dir):
    return B.stock_level(lending(spark, sf_dir))


@register("equipment_status", oracle("""
SELECT id, item_name, physical_stock, outstanding_in_use, available_for_new_borrow, active,
       active AND available_for_new_borrow > 0 AS can_borrow
FROM _item_units"""))
def q_equipment_status(spark, sf_dir):
    return B.equipment_status(lending(spark, sf_dir))


@register("inventory_kpis", oracle("""
SELECT CAST(SUM(physical_stock) AS BIGINT) AS total_stock,
       CAST(SUM(outstanding_in_use) AS BIGINT) AS total_out,
       CAST(SUM(available_for_new_borrow) AS BIGINT) AS total_available,
       COUNT(*) AS items
FROM _item_units"""))
def q_inventory_kpis(spark, sf_dir):
    return B.inventory_kpis(lending(spark, sf_dir))


@register("inventory_list", oracle("""
SELECT * FROM _item_units ORDER BY active DESC, item_name ASC, id ASC"""))
def q_inventory_list(spark, sf_dir):
    return B.inventory_list(lending(spark, sf_dir))


SEARCH_TERM = "Red Widget"


@register("inventory_search", oracle(f"""
SELECT * FROM _item_units
WHERE contains(lower(item_name), lower(trim('{SEARCH_TERM}')))"""))
def q_inventory_search(spark, sf_dir):
    return B.inventory_search(lending(spark, sf_dir), SEARCH_TERM)


@register("lendable_items", oracle("""
SELECT id, item_name AS name, stock, GREATEST(0, LEAST(stock, 10)) AS max_qty
FROM inventory WHERE active = TRUE AND stock > 0"""))
def q_lendable_items(spark, sf_dir):
    return B.lendable_items(lending(spark, sf_dir))


@register("item_list", oracle("SELECT id, item_name, stock, active FROM inventory"))
def q_item_list(spark, sf_dir):
    return B.item_list(lending(spark, sf_dir))


@register("open_loans", oracle("SELECT * FROM transactions WHERE return_date IS NULL"))
def q_open_loans(spark, sf_dir):
    return B.open_loans(lending(spark, sf_dir))


@register("loan_age", oracle(f"""
SELECT id AS tx_id, user_id, borrow_date, CAST({AS_OF_SQL} - borrow_date AS INTEGER) AS days
FROM transactions"""))
def q_loan_age(spark, sf_dir):
    l = lending(spark, sf_dir)
    return l.transactions.select(F.col("id").alias("tx_id"), "user_id", "borrow_date",
                                 B.loan_age(AS_OF).alias("days"))


@register("role_list", oracle("SELECT id, name FROM roles"))
def q_role_list(spark, sf_dir):
    return B.role_list(lending(spark, sf_dir))
