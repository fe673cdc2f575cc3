"""Canonical schemas as DDL. Fixed after the cleaning step, never inferred."""

from __future__ import annotations

SALES = """
location_id string, sale_id string, date date, time string, hour int, items_sold string, items array<string>,
number_of_items int, subtotal decimal(18,2), tip decimal(18,2), total_amount decimal(18,2), payment_method string,
order_type string, employee_id string, customer_id string, is_loyalty_member boolean, promotion_id string,
discount_percent double, discount_applied decimal(18,2), table_number string, covers int, comps decimal(18,2),
voids decimal(18,2), promos decimal(18,2), tax decimal(18,2), daypart string, void_status boolean, filename string
"""

INVENTORY = """
location_id string, date date, ingredient string, quantity double, par_level double, unit_cost decimal(18,2),
category string, unit string, is_low boolean, waste double, supplier string, last_ordered_date date, filename string,
total_value decimal(18,2), inventory_ratio double, alert string
"""

MENU = """
location_id string, date date, menu_item string, ingredient string, amount double, unit_cost decimal(18,2),
category string, item_price decimal(18,2), created_at date, updated_at date, is_active boolean, filename string,
ingest_seq bigint, total_cost decimal(31,5), profit_margin double
"""

LABOR = """
location_id string, date date, employee_id string, name string, position string, role string,
hourly_rate decimal(18,2), hours_worked double, overtime_hours double, is_overtime boolean, is_salaried boolean,
department string, hire_date date, termination_date date, filename string, total_wages decimal(18,2)
"""

POS_ORDER = """
location_id string, order_id string, order_date date, order_ts timestamp, total decimal(18,2), status string,
items array<struct<menu_item_name: string, quantity: int, amount: double, food_cost: double>>,
ingest_ts timestamp
"""

# Header aliases of the four upload categories.
SALES_HEADERS = {
    "Date": "date", "Sale ID": "sale_id", "Time": "time", "Items Sold": "items_sold",
    "Number of Items": "number_of_items", "Subtotal": "subtotal", "Tip": "tip", "Total Amount": "total_amount",
    "Employee ID": "employee_id", "Is Loyalty Member": "is_loyalty_member", "Promotion ID": "promotion_id",
    "Discount Percent": "discount_percent", "Order Type": "order_type", "Payment Method": "payment_method",
    "Covers": "covers",
}
INVENTORY_HEADERS = {
    "Date": "date", "Ingredient": "ingredient", "Quantity": "quantity", "Par Level": "par_level",
    "Unit Cost": "unit_cost", "Is Low": "is_low", "Unit of Measure": "unit_of_measure", "Supplier": "supplier",
    "Last Ordered Date": "last_ordered_date",
}
MENU_HEADERS = {
    "Menu Item": "menu_item", "Ingredient": "ingredient", "Amount": "amount", "Unit Cost": "unit_cost",
    "Created At": "created_at", "Category": "category", "Item Price": "item_price", "Is Active": "is_active",
}
LABOR_HEADERS = {
    "Date": "date", "Employee ID": "employee_id", "Name": "name", "Position": "position",
    "Hours Worked": "hours_worked", "Hourly Rate": "hourly_rate", "Is Salaried": "is_salaried",
    "Is Overtime": "is_overtime", "Department": "department", "Overtime Hours": "overtime_hours",
}
