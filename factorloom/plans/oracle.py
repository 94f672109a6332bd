"""Shared common table expressions for the DuckDB side of the checks."""

from __future__ import annotations

SYM = "lpad(CAST({} AS VARCHAR),6,'0')"
MONTH = "CAST(date_trunc('month',l_shipdate) AS DATE)"


def r(expr: str) -> str:
    return f"round({expr},8)+0.0"


# name -> (names it reads, body)
CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "px": ((), f"SELECT {SYM.format('l_suppkey')} AS symbol, {MONTH} AS d, "
               "sum(l_extendedprice)/sum(l_quantity)/7 AS price FROM lineitem GROUP BY 1,2"),
    "px_day": ((), f"SELECT {SYM.format('l_suppkey')} AS symbol, CAST(l_shipdate AS DATE) AS d, "
                   "sum(l_extendedprice)/sum(l_quantity)/7 AS price FROM lineitem GROUP BY 1,2"),
    "fx": ((), f"""SELECT {SYM.format('l_suppkey')} AS symbol, {MONTH} AS d,
        CASE WHEN (l_suppkey + month({MONTH})) % 17 = 0 THEN NULL ELSE round(avg(l_discount),10) END AS f_disc,
        sum(l_quantity) AS f_qty, round(avg(l_tax),10) AS f_tax,
        round(avg(CASE WHEN l_returnflag='R' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END),10) AS f_ret
        FROM lineitem GROUP BY l_suppkey, {MONTH}"""),
    "industry": ((), f"SELECT {SYM.format('s_suppkey')} AS symbol, s_nationkey % 5 AS industry FROM supplier"),
    "industry_dated": ((), f"""SELECT y.d, {SYM.format('s_suppkey')} AS symbol, (s_nationkey + year(y.d)) % 5 AS industry
        FROM (SELECT DISTINCT CAST(date_trunc('year',l_shipdate) AS DATE) AS d, l_suppkey FROM lineitem) y
        JOIN supplier ON s_suppkey = y.l_suppkey"""),
    "ledger": ((), f"""SELECT o_orderkey AS order_id, CAST(o_orderdate AS DATE) AS d, {SYM.format('o_custkey')} AS symbol,
        CASE WHEN o_orderstatus='F' THEN 'SELL' ELSE 'BUY' END AS side, o_totalprice AS gross FROM orders"""),
    "adj": (("px",), """SELECT symbol, d, CASE WHEN CAST(symbol AS INT) % 3 = 0
        THEN 1 + CAST(0.1 AS DOUBLE)*(year(d)-1991) ELSE CAST(1 AS DOUBLE) END AS adj FROM px"""),
    "st": (("fx",), "SELECT symbol, d, f_ret > 0.5 AS st FROM fx"),
    "pool": (("fx",), "SELECT symbol, d, f_qty >= avg(f_qty) OVER (PARTITION BY d) AS member FROM fx"),
    "sparse": (("fx",), "SELECT symbol, CAST(d + INTERVAL 14 DAY AS DATE) AS d, f_disc, f_qty, f_tax, f_ret "
                        "FROM fx WHERE month(d) % 3 = 0"),
    "benchmark": (("px",), "SELECT d, avg(price) AS value FROM px GROUP BY d"),
    "sess": (("px",), "SELECT d, row_number() OVER (ORDER BY d) AS idx FROM (SELECT DISTINCT d FROM px)"),
    "pxi": (("px", "sess"), "SELECT p.symbol, p.d, s.idx, p.price FROM px p JOIN sess s ON s.d = p.d"),
    # every month is both signal and session: entry one session on, exit two
    "lab": (("fx", "sess", "pxi"), """SELECT f.symbol, f.d, b.price/a.price-1 AS label,
        e.d AS label_entry_date, x.d AS label_exit_date
        FROM fx f JOIN sess s ON s.d = f.d
        LEFT JOIN sess e ON e.idx = s.idx+1 AND s.idx + 2 <= (SELECT max(idx) FROM sess)
        LEFT JOIN sess x ON x.idx = s.idx+2
        LEFT JOIN pxi a ON a.symbol = f.symbol AND a.idx = s.idx+1 AND s.idx + 2 <= (SELECT max(idx) FROM sess)
        LEFT JOIN pxi b ON b.symbol = f.symbol AND b.idx = s.idx+2"""),
    "data": (("fx", "lab"), """SELECT f.d, f.symbol, f.f_disc, f.f_qty, f.f_tax, f.f_ret, l.label, l.label_entry_date,
        l.label_exit_date FROM fx f LEFT JOIN lab l ON l.d = f.d AND l.symbol = f.symbol"""),
    # two "models": one scores by quantity, the other by discount (with gaps)
    "pred": (("data",), """SELECT 'qty' AS model, d, symbol, label, label_exit_date, f_qty AS prediction FROM data
        UNION ALL SELECT 'disc', d, symbol, label, label_exit_date, f_disc FROM data"""),
    "pairs": (("pred",), """SELECT *, rank() OVER (PARTITION BY model, d ORDER BY prediction)
            + (count(*) OVER (PARTITION BY model, d, prediction) - 1)/2.0 AS rp,
        rank() OVER (PARTITION BY model, d ORDER BY label) + (count(*) OVER (PARTITION BY model, d, label) - 1)/2.0 AS rl,
        row_number() OVER (PARTITION BY model, d ORDER BY prediction, symbol) AS pos,
        count(*) OVER (PARTITION BY model, d) AS n
        FROM pred WHERE prediction IS NOT NULL AND label IS NOT NULL"""),
    "ic": (("pairs",), """SELECT model, d, CASE WHEN n > 1 AND sp > 1e-12 AND sl > 1e-12 THEN ric END AS rank_ic,
        CASE WHEN n > 1 AND sp > 1e-12 AND sl > 1e-12 THEN pic END AS pearson_ic, n AS stock_count,
        sp AS prediction_std, sl AS label_std FROM (SELECT model, d, count(*) AS n, corr(rp, rl) AS ric,
        corr(prediction, label) AS pic, stddev_samp(prediction) AS sp, stddev_samp(label) AS sl
        FROM pairs GROUP BY model, d)"""),
}


def sql(body: str, *names: str, extra: dict[str, str] | None = None) -> str:
    """``WITH`` the named expressions and all they read, then ``extra`` ones, then ``body``."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name not in order:
            for dep in CTES[name][0]:
                visit(dep)
            order.append(name)

    for name in names:
        visit(name)
    parts = [f"{n} AS ({CTES[n][1]})" for n in order] + [f"{k} AS ({v})" for k, v in (extra or {}).items()]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body
