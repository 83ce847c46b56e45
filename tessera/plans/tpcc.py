"""An order-processing schema and the statements of its transactions, as an acceptance workload for the dialect."""

from __future__ import annotations

from tessera.plans.session import Session

#: Fixed by the workload: tables, columns and keys.
DDL = (
    "CREATE TABLE warehouse (w_id int NOT NULL, w_ytd decimal(12,2), w_tax decimal(4,4), w_name varchar(10), w_street_1 varchar(20), w_street_2 varchar(20), w_city varchar(20), w_state char(2), w_zip char(9), PRIMARY KEY (w_id))",
    "CREATE TABLE item (i_id int NOT NULL, i_name varchar(24), i_price decimal(5,2), i_data varchar(50), i_im_id int, PRIMARY KEY (i_id))",
    f"CREATE TABLE stock (s_w_id int, s_i_id int, s_quantity int, s_ytd decimal(8,2), s_order_cnt int, s_remote_cnt int, s_data varchar(50), {', '.join(f's_dist_{i:02d} char(24)' for i in range(1, 11))}, PRIMARY KEY (s_w_id, s_i_id))",
    "CREATE TABLE district (d_w_id int, d_id int, d_ytd decimal(12,2), d_tax decimal(4,4), d_next_o_id int, d_name varchar(10), d_street_1 varchar(20), d_street_2 varchar(20), d_city varchar(20), d_state char(2), d_zip char(9), PRIMARY KEY (d_w_id, d_id))",
    "CREATE TABLE customer (c_w_id int, c_d_id int, c_id int, c_discount decimal(4,4), c_credit char(2), c_last varchar(16), c_first varchar(16), c_credit_lim decimal(12,2), c_balance decimal(12,2), c_ytd_payment float, c_payment_cnt int, c_delivery_cnt int, c_street_1 varchar(20), c_street_2 varchar(20), c_city varchar(20), c_state char(2), c_zip char(9), c_phone char(16), c_since timestamp, c_middle char(2), c_data varchar(500), PRIMARY KEY (c_w_id, c_d_id, c_id))",
    "CREATE INDEX idx_customer_name ON customer (c_w_id, c_d_id, c_last, c_first)",
    "CREATE TABLE history (h_c_id int, h_c_d_id int, h_c_w_id int, h_d_id int, h_w_id int, h_date timestamp, h_amount decimal(6,2), h_data varchar(24))",
    "CREATE TABLE oorder (o_w_id int, o_d_id int, o_id int, o_c_id int, o_carrier_id int DEFAULT NULL, o_ol_cnt int, o_all_local int, o_entry_d timestamp, PRIMARY KEY (o_w_id, o_d_id, o_id))",
    "CREATE TABLE new_order (no_w_id int, no_d_id int, no_o_id int, PRIMARY KEY (no_w_id, no_d_id, no_o_id))",
    "CREATE TABLE order_line (ol_w_id int, ol_d_id int, ol_o_id int, ol_number int, ol_i_id int, ol_delivery_d timestamp NULL, ol_amount decimal(6,2), ol_supply_w_id int, ol_quantity decimal(2,0), ol_dist_info char(24), PRIMARY KEY (ol_w_id, ol_d_id, ol_o_id, ol_number))",
)
SAMPLE = (
    "INSERT INTO warehouse VALUES (1, 300000.0, 0.1, 'w', 'a', 'b', 'c', 'XX', '123456789')",
    "INSERT INTO item VALUES (1, 'thing', 9.5, 'data', 7)",
    f"INSERT INTO stock VALUES (1, 1, 20, 0, 0, 0, 'data', {', '.join(f'{chr(39)}dist{i}{chr(39)}' for i in range(1, 11))})",
    "INSERT INTO district VALUES (1, 1, 30000, 0.05, 2, 'd', 'a', 'b', 'c', 'XX', '123456789')",
    "INSERT INTO customer VALUES (1, 1, 1, 0.1, 'GC', 'BAR', 'Ann', 50000, -10, 10, 1, 0, 'a', 'b', 'c', 'XX', '123456789', '0123', '2026-01-01 00:00:00', 'OE', 'data')",
    "INSERT INTO oorder (o_w_id, o_d_id, o_id, o_c_id, o_ol_cnt, o_all_local, o_entry_d) VALUES (1, 1, 1, 1, 1, 1, '2026-01-02 00:00:00')",
    "INSERT INTO new_order VALUES (1, 1, 1)",
    "INSERT INTO order_line (ol_w_id, ol_d_id, ol_o_id, ol_number, ol_i_id, ol_amount, ol_supply_w_id, ol_quantity, ol_dist_info) VALUES (1, 1, 1, 1, 1, 47.5, 1, 5, 'dist1')",
)
STOCK_LEVEL = "SELECT COUNT(DISTINCT (S_I_ID)) AS STOCK_COUNT FROM order_line, stock WHERE OL_W_ID = ? AND OL_D_ID = ? AND OL_O_ID >= ? AND OL_O_ID < ? AND S_W_ID = ? AND S_I_ID = OL_I_ID AND S_QUANTITY < ?"
#: Payment, stock level, order status, new order and delivery, in turn.
TRANSACTIONS = (
    ("UPDATE warehouse SET w_ytd = w_ytd + ? WHERE w_id = ?", [10.5, 1]),
    ("SELECT w_name, w_tax FROM warehouse WHERE w_id = ?", [1]),
    ("UPDATE district SET d_ytd = d_ytd + ? WHERE d_w_id = ? AND d_id = ?", [10.5, 1, 1]),
    ("SELECT c_first, c_id FROM customer WHERE c_w_id = ? AND c_d_id = ? AND c_last = ? ORDER BY c_first", [1, 1, "BAR"]),
    ("UPDATE customer SET c_balance = ?, c_ytd_payment = ?, c_payment_cnt = ? WHERE c_w_id = ? AND c_d_id = ? AND c_id = ?", [-20.5, 20.5, 2, 1, 1, 1]),
    ("INSERT INTO history (h_c_d_id, h_c_w_id, h_c_id, h_d_id, h_w_id, h_date, h_amount, h_data) VALUES (?, ?, ?, ?, ?, ?, ?, ?)", [1, 1, 1, 1, 1, "2026-01-03 00:00:00", 10.5, "it's"]),
    (STOCK_LEVEL, [1, 1, 1, 21, 1, 100]),
    ("SELECT o_id, o_carrier_id, o_entry_d FROM oorder WHERE o_w_id = ? AND o_d_id = ? AND o_c_id = ? ORDER BY o_id DESC LIMIT 1", [1, 1, 1]),
    ("SELECT ol_i_id, ol_amount FROM order_line WHERE ol_o_id = ? AND ol_d_id = ? AND ol_w_id = ?", [1, 1, 1]),
    ("SELECT d_next_o_id, d_tax FROM district WHERE d_w_id = ? AND d_id = ? FOR UPDATE", [1, 1]),
    ("UPDATE district SET d_next_o_id = d_next_o_id + 1 WHERE d_w_id = ? AND d_id = ?", [1, 1]),
    ("INSERT INTO oorder (o_id, o_d_id, o_w_id, o_c_id, o_entry_d, o_ol_cnt) VALUES (?, ?, ?, ?, ?, ?)", [2, 1, 1, 1, "2026-01-04 00:00:00", 1]),
    ("INSERT INTO new_order (no_o_id, no_d_id, no_w_id) VALUES (?, ?, ?)", [2, 1, 1]),
    ("SELECT i_price, i_name, i_data FROM item WHERE i_id = ?", [1]),
    ("SELECT s_quantity, s_data, s_dist_01, s_dist_10 FROM stock WHERE s_i_id = ? AND s_w_id = ? FOR UPDATE", [1, 1]),
    ("UPDATE stock SET s_quantity = ?, s_ytd = s_ytd + ?, s_order_cnt = s_order_cnt + 1, s_remote_cnt = s_remote_cnt + ? WHERE s_i_id = ? AND s_w_id = ?", [15, 5, 0, 1, 1]),
    ("SELECT no_o_id FROM new_order WHERE no_d_id = ? AND no_w_id = ? ORDER BY no_o_id ASC LIMIT 1", [1, 1]),
    ("DELETE FROM new_order WHERE no_o_id = ? AND no_d_id = ? AND no_w_id = ?", [1, 1, 1]),
    ("UPDATE oorder SET o_carrier_id = ? WHERE o_id = ? AND o_d_id = ? AND o_w_id = ?", [3, 1, 1, 1]),
    ("UPDATE order_line SET ol_delivery_d = ? WHERE ol_o_id = ? AND ol_d_id = ? AND ol_w_id = ?", ["2026-01-05 00:00:00", 1, 1, 1]),
    ("SELECT SUM(ol_amount) AS ol_total FROM order_line WHERE ol_o_id = ? AND ol_d_id = ? AND ol_w_id = ?", [1, 1, 1]),
    ("UPDATE customer SET c_balance = c_balance + ?, c_delivery_cnt = c_delivery_cnt + 1 WHERE c_w_id = ? AND c_d_id = ? AND c_id = ?", [47.5, 1, 1, 1]),
)


def create(db: Session) -> None:
    for name in ("warehouse", "item", "stock", "district", "customer", "history", "oorder", "new_order", "order_line"):
        db.execute(f"DROP TABLE IF EXISTS {name} CASCADE")
    for s in DDL:
        db.execute(s)


def sample(db: Session) -> None:
    for s in SAMPLE:
        db.execute(s)
