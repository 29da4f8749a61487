"""Parameters of the registered reports."""

RANGE_FROM, RANGE_UNTIL = "1998-01-01 00:00:00", "1998-02-01 00:00:00"
#: Sales from here on come with a later batch.
BATCH_UNTIL = "1997-01-01 00:00:00"
#: Keys that are looked up in layouts.
WANTED = {"customer_id": 19, "branch_id": 3, "product_id": 17, "employee_id": 5}
AS_OF = "2001-08-01"
SELECTED_BRANCH = "Nation_3 Branch"
#: A column of each view whose total is compared.
VIEW_TOTALS = {
    "monthly_sales_summary": "net_revenue",
    "branch_performance": "net_revenue",
    "product_performance": "gross_revenue",
    "customer_summary": "total_spent",
    "inventory_risk": "inventory_retail_value",
    "employee_performance": "net_revenue",
    "customer_segments": "monetary_value",
    "executive_summary": "net_revenue",
}
