"""Reconciliation tables derived from the ``orders`` and ``lineitem`` tables.

Every order is a purchase, its lines are ledger rows and its invoices are sums of lines. The rules on
the order key disturb the copies (missing numbers, misread characters, duplicates, late totals...), so
that every branch of the matching is reached. No row is left out to make anything cheaper.

The statements below run unchanged in Spark and in DuckDB; ``{name}`` stands for an input table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerloom.functions import patterns as P
from ledgerloom.sources.scratch import written

LEDGER0 = """
select ok, seq, row_no, iseq, invoice_number, po_number, supplier, status, invoice_date,
 case when ok%5=1 then invoice_date + 30 end as due_date, description, unit_no, unit_price,
 cast(excl as decimal(18,2)) as excl, cast(incl as decimal(18,2)) as incl
from (select l_orderkey as ok, seq, l_orderkey*100+seq as row_no,
 case when l_orderkey%3=0 then seq%2 else 0 end as iseq,
 case when l_orderkey%11=0 then null else concat('INV-',lpad(cast(l_orderkey as string),7,'0'),'-',
   cast(case when l_orderkey%3=0 then seq%2 else 0 end as string)) end as invoice_number,
 concat('PO',cast(year(o_orderdate) as string),lpad(cast(l_orderkey as string),7,'0')) as po_number,
 upper(translate(substring(md5(cast(sk as string)),1,10),'0123456789','ghijklmnop')) as supplier,
 case o_orderstatus when 'F' then 'Delivered' when 'P' then 'Pending Payment' else 'Ordered' end as status,
 cast(o_orderdate as date) as invoice_date,
 concat('Part ', cast(l_partkey as string)) as description,
 cast(l_quantity as decimal(18,2)) as unit_no,
 cast(l_extendedprice as decimal(18,2)) as unit_price,
 round(cast(l_extendedprice as decimal(18,2))*(1-cast(l_discount as decimal(4,2))),2) as excl,
 round(round(cast(l_extendedprice as decimal(18,2))*(1-cast(l_discount as decimal(4,2))),2)*1.09,2) as incl
 from (select l.*, o.o_orderdate, o.o_orderstatus, min(l_suppkey) over (partition by l_orderkey) as sk,
   row_number() over (partition by l_orderkey order by l_linenumber,l_partkey,l_suppkey,l_quantity,
     l_extendedprice,l_discount,l_tax,l_shipdate) as seq
   from {lineitem} l join {orders} o on l_orderkey=o_orderkey) l) z
"""

LEDGER = """
select invoice_number, po_number, supplier, invoice_date, due_date, description, unit_no,
 cast(null as string) as currency, unit_price, excl, cast(incl-excl as decimal(18,2)) as gst, incl,
 invoice_number as invoice_key, po_number as po_key, supplier as supplier_key, status, row_no
from {ledger0} where ok%29<>0
"""

INVOICE_BASE = """
select ok,iseq,po_number,supplier,min(invoice_date) as d,sum(excl) as e,sum(incl) as i,sum(unit_no) as q,
 concat('INV-',lpad(cast(ok as string),7,'0'),'-',cast(iseq as string)) as num
from {ledger0} where ok%23<>0 group by ok,iseq,po_number,supplier
"""

INVOICE_ROWS = """
select ok, iseq, ok*100+iseq*10+dup as doc_id, po_number as po_no, supplier as ledger_supplier,
 case when ok%53=0 then null when ok%9=4 then concat(supplier,' Pte Ltd')
      when ok%5=0 then substring(supplier,1,9) else supplier end as supplier,
 case when ok%43=0 then null else d end as invoice_date,
 case when ok%5<3 then d + 30 end as due_date,
 case when dup=2 then null when ok%19=0 and not (ok%2=0 and iseq=1) then null
      when ok%17=0 then translate(num,'0','O') else num end as invoice_no,
 ok%17=0 as ocr, (ok%31=0 and iseq=0) as is_proforma,
 cast(e as decimal(18,2)) as excl, cast(q as decimal(18,2)) as qty,
 cast(i + case when ok%13=0 and iseq=0 then 10 else 0 end + dup as decimal(18,2)) as incl
"""

INVOICE_HEAD = INVOICE_ROWS + """from (select b.*,0 as dup from {invoice_base} b union all
      select b.*,1 as dup from {invoice_base} b where ok%37=0 union all
      select b.*,2 as dup from {invoice_base} b where ok%41=0 and iseq=0) u
"""

LEDGER_RAW = """
select case when ok%29=0 then null else status end as status,
 case when ok%7=0 then null else concat(substring(supplier,1,1), lower(substring(supplier,2,9)), ' Pte. Ltd') end as ordered_from,
 concat('brand ', lower(supplier)) as brand,
 case when ok%2=0 then ' ' || lower(invoice_number) || ' #' else invoice_number end as invoice_number,
 case when ok%8=3 then '' else concat(po_number, '.') end as po_number,
 unit_price as unit_cost, unit_no as units,
 case when seq%9=8 then null else cast(round(cast(unit_price*unit_no as decimal(18,2))*1.09,2) as decimal(18,2)) end as total_cost,
 case when ok%4=0 then '30 Days from Invoice' when ok%4=1 then concat('net ', cast(ok%90 as string), 'days') end as notes,
 case when ok%43=0 then null else invoice_date end as invoice_date,
 description as item_description, row_no
from {ledger0}
"""

VENDOR = """
select case when s_suppkey%6=5 then ' ' else concat(letters, case when s_suppkey%2=0 then ' Asia Ltd' else '' end) end as vendor,
 case when s_suppkey%4=0 then null else concat('Brand ', letters, ', ', letters, ' Labs / x', letters) end as brands,
 cast(s_suppkey as int) as row_no
from (select s_suppkey, upper(translate(substring(md5(cast(s_suppkey as string)),1,10),'0123456789','ghijklmnop')) as letters
      from {supplier}) s
"""

_CACHE: dict[tuple[str, str, str], DataFrame] = {}


#: Tables that are a row-wise projection of one stored table; a second copy of it would only cost disk.
VIEWS = ("ledger", "ledger_raw", "vendor", "invoice", "rendered")


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One derived table, written once per session and read back like any input table, or a view of such a table."""
    slot = (spark.sparkContext.applicationId, sf_dir, name)
    if slot not in _CACHE:
        table = _BUILDERS[name](spark, sf_dir)
        _CACHE[slot] = table if name in VIEWS else written(table, name, compression="zstd")
    return _CACHE[slot]


def base_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _ledger0(spark, sf_dir):
    return spark.sql(LEDGER0, lineitem=base_table(spark, sf_dir, "lineitem"),
                     orders=base_table(spark, sf_dir, "orders"))


def _ledger(spark, sf_dir):
    return spark.sql(LEDGER, ledger0=derived(spark, sf_dir, "ledger0"))


def _ledger_raw(spark, sf_dir):
    return spark.sql(LEDGER_RAW, ledger0=derived(spark, sf_dir, "ledger0"))


def _vendor(spark, sf_dir):
    return spark.sql(VENDOR, supplier=base_table(spark, sf_dir, "supplier"))


def _invoice_base(spark, sf_dir):
    return spark.sql(INVOICE_BASE, ledger0=derived(spark, sf_dir, "ledger0"))


def _invoice(spark, sf_dir):
    """Invoice documents; those of even orders bill one consolidated line, the others only a total.

    The three branches of ``INVOICE_HEAD`` in one pass, so the table can be a view: who reads a few columns makes no others.
    """
    dups = F.expr("""case when ok%37=0 and ok%41=0 and iseq=0 then array(0,1,2) when ok%37=0 then array(0,1)
        when ok%41=0 and iseq=0 then array(0,2) else array(0) end""")
    copies = derived(spark, sf_dir, "invoice_base").select("*", F.explode_outer(dups).alias("dup"))
    head = spark.sql(INVOICE_ROWS + "from {copies}", copies=copies)
    gst = (F.col("incl") - F.col("excl")).cast("decimal(18,2)")
    item = F.struct(
        F.concat(F.lit("Goods of "), "po_no").alias("description"), "qty",
        F.lit(None).cast("decimal(18,2)").alias("unit_price"), F.col("excl").alias("amount_excl"),
        gst.alias("gst"), F.col("incl").alias("amount_incl"))
    day = F.coalesce(F.date_format("invoice_date", "yyyy-MM-dd"), F.lit("undated"))
    name = F.concat(
        "po_no", F.lit("_-_"), day,
        F.when(F.col("is_proforma"), F.lit(" Proforma Invoice")).otherwise(F.lit(" Tax Invoice")),
        F.when(F.col("supplier").isNull() | (F.col("ok") % 9 == 4), F.lit(""))
        .when(F.col("ok") % 3 == 1, F.concat(F.lit(" (Tax Invoice copy, "), "supplier", F.lit(")")))
        .when(F.col("ok") % 3 == 2, F.concat(F.lit(" ("), "supplier", F.lit(", item 1 out of 3)")))
        .otherwise(F.concat(F.lit(" ("), "supplier", F.lit(")"))),
        F.lit(".pdf"))
    return head.select(
        "ok", "iseq", "ledger_supplier", "doc_id", F.col("doc_id").alias("file_order"), name.alias("source_file"),
        "invoice_no", "po_no", "supplier",
        F.lit(None).cast("string").alias("supplier_from_body"),
        F.lit(None).cast("string").alias("supplier_from_filename"),
        F.lit("SGD").alias("currency"), F.lit(None).cast("string").alias("terms"),
        "invoice_date", "due_date", "is_proforma", "ocr", F.lit(False).alias("second_reader"),
        F.struct(F.col("excl").alias("amount_excl"), gst.alias("gst"),
                 F.col("incl").alias("amount_incl")).alias("subtotal"),
        F.filter(F.array(item), lambda _: F.col("ok") % 2 == 0).alias("line_items"),
        F.when(F.col("invoice_no").isNull(), F.array(F.lit(P.WARN_NO_NUMBER)))
        .otherwise(F.array().cast("array<string>")).alias("warnings"))


def _rendered(spark, sf_dir):
    """Lines of text of every invoice in one of five layouts, the way suppliers print them."""
    inv = derived(spark, sf_dir, "invoice").withColumn(
        "form", F.when(F.col("ocr"), F.pmod(F.expr("ok div 7"), F.lit(4))).otherwise(F.pmod(F.expr("ok div 7"), F.lit(5))))
    no, po, day, due = F.col("invoice_no"), F.col("po_no"), F.col("invoice_date"), F.col("due_date")
    e, g, i = (F.format_number(F.col(f"subtotal.{n}"), 2) for n in ("amount_excl", "gst", "amount_incl"))

    def line(label: str, value) -> object:
        return F.concat(F.lit(label), value)

    def date(c, fmt: str):
        return F.date_format(c, fmt)

    name = F.when(F.col("supplier").isNotNull(), F.concat("ledger_supplier", F.lit(" Pte Ltd")))
    wide = 24

    def columns(*cells):
        return F.concat(*[F.coalesce(F.rpad(c, wide, " "), F.lit("")) for c in cells])

    heads = {
        0: [name, F.lit("TAX INVOICE"), line("Invoice No: ", no), line("Invoice Date: ", date(day, "dd/MM/yyyy")),
            line("Due Date: ", date(due, "dd/MM/yyyy")), line("PO No: ", po)],
        1: [name, line("Invoice Number ", no), line("Due Date: ", date(due, "dd/MM/yyyy")),
            line("Date: ", date(day, "yyyy-MM-dd")), line("Your Ref: ", po), F.lit("Terms of delivery on request")],
        2: [name, F.coalesce(line("Tax Invoice ", no), F.lit("Tax Invoice")),
            line("Invoice Date: ", date(day, "d MMMM yyyy")), line("Reference ", po)],
        3: [name,
            columns(F.when(no.isNotNull(), F.lit("Invoice Number")), F.when(day.isNotNull(), F.lit("Invoice Date")), F.lit("Reference")),
            columns(no, date(day, "dd/MM/yyyy"), po)],
        4: [name, F.lit("TAX INVOICE"), F.lit("Goods supplied as listed in the schedule below"), F.lit("Currency SGD")],
    }
    feet = {
        0: [line("Subtotal ", e), line("GST 9% ", g), line("Total SGD ", i)],
        1: [line("TOTAL EXCL. GST ", e), line("GST 9% ", g), line("TOTAL USD ", i)],
        2: [line("Untaxed Amount S$ ", e), line("TAX 9% S$ ", g), F.concat(F.lit("Total S$ "), i, F.lit(" ."))],
        3: [line("Items Sub-Total ", e), F.concat(F.lit(" " * 40), F.lit("TOTAL CURRENCY")),
            F.concat(F.lit(" " * 40), i, F.lit(" SGD"))],
        4: [F.lit("Thank you for the order placed with our company")],
    }

    def pick(blocks):
        chosen = None
        for form, lines in blocks.items():
            value = F.array(*lines)
            chosen = F.when(F.col("form") == form, value) if chosen is None else chosen.when(F.col("form") == form, value)
        return F.filter(chosen, lambda x: x.isNotNull())

    head_cells = [(F.lit("Invoice No"), no), (F.lit("Invoice Date"), date(day, "yyyy-MM-dd")), (F.lit("PO No"), po),
                  (F.lit("Due Date"), date(due, "yyyy-MM-dd")), (F.lit("Terms"), F.lit("30 Days"))]
    item = F.transform("line_items", lambda x: F.array(
        F.lit("1"), x["description"], F.format_number(x["qty"], 2), F.lit(""),
        F.format_number(x["amount_excl"], 2), F.format_number(x["gst"], 2), F.format_number(x["amount_incl"], 2)))
    goods = F.concat(
        F.array(F.array(*[F.lit(h) for h in ("No", "Item  Description", "Qty", "Unit Price", "Amount Excl",
                                             "GST Amount", "Total Amount")])),
        item, F.array(F.array(F.lit("Total"), F.lit(""), F.lit(""), F.lit(""), e, g, i)))
    tables = F.when(F.col("form") == 4, F.array(
        F.array(F.array(*[h for h, _ in head_cells]), F.array(*[v for _, v in head_cells])), goods)
    ).otherwise(F.array().cast("array<array<array<string>>>"))
    return inv.select("doc_id", F.col("source_file").alias("path"), "ok", "ocr", "form",
                      pick(heads).alias("head"), pick(feet).alias("foot"), tables.alias("tables"))


def _page(spark, sf_dir):
    """Native pages: scans show next to nothing, every third order has its totals on a second page."""
    r = derived(spark, sf_dir, "rendered")
    two = (F.col("ok") % 3 == 0) & ~F.col("ocr")
    blank = F.array(F.lit(" ."))
    parts = F.when(F.col("ocr"), F.array(blank)).when(two, F.array("head", "foot")).otherwise(
        F.array(F.concat("head", "foot")))
    p = r.select("doc_id", F.concat(F.lit("invoices/"), "path").alias("path"), "tables",
                 F.posexplode_outer(parts).alias("page", "lines"))
    layout = F.array_join("lines", "\n")
    return p.select("doc_id", "path", (F.col("page") + 1).cast("int").alias("page_no"),
                    F.regexp_replace(layout, "[ ]{2,}", " ").alias("text"), layout.alias("layout_text"),
                    F.when(F.col("page") == 0, F.col("tables")).otherwise(F.array()).alias("tables"))


def _ocr_page(spark, sf_dir):
    """What recognition sees on the scans; the first hyphen of the number reads as a tilde."""
    r = derived(spark, sf_dir, "rendered").where("ocr")
    layout = F.regexp_replace(F.array_join(F.concat("head", "foot"), "\n"), "INV-", "INV~")
    return r.select("doc_id", F.lit(1).alias("page_no"),
                    F.regexp_replace(layout, "[ ]{2,}", " ").alias("text"), layout.alias("layout_text"))


def _word(spark, sf_dir):
    """Word boxes of all rendered documents: nine pixels per column, one stray faint word per line.

    The faint word is the one after a line's last. Outer generators, as Spark checks the others' arrays for emptiness
    first and so makes them twice.
    """
    r = derived(spark, sf_dir, "rendered").select("doc_id", F.posexplode_outer(F.concat("head", "foot")).alias("line", "text"))
    faint = F.col("word").isNull()
    w = r.where("text is not null").select("doc_id", "line", "text", F.posexplode_outer(
        F.concat(F.split("text", " "), F.array(F.lit(None).cast("string")))).alias("i", "word")).where(faint | (F.col("word") != ""))
    left = F.expr("length(substring_index(text, ' ', i))") + F.when(F.col("i") > 0, 1).otherwise(0)
    conf = F.when(F.col("i") % 5 == 4, F.lit("n/a")).otherwise((30 + F.col("i") % 60).cast("string"))
    return w.select(
        "doc_id", F.lit(1).alias("page_no"), F.lit(1).alias("block"), F.lit(1).alias("par"),
        F.col("line").cast("int").alias("line"),
        F.when(faint, F.lit(2)).otherwise((left * 9 + F.col("i") % 9).cast("int")).alias("left"),
        F.when(faint, F.lit("29")).otherwise(conf).alias("conf"),
        F.coalesce("word", F.lit("smudge")).alias("text"))


def _second_reader(spark, sf_dir):
    """JSON answers for all documents, plain, fenced, with a lead-in, or cut off."""
    inv = derived(spark, sf_dir, "invoice")
    s = F.col("subtotal")
    body = F.to_json(F.struct(
        "invoice_no", F.date_format("invoice_date", "yyyy-MM-dd").alias("invoice_date"), "po_no", "supplier",
        F.lit("SGD").alias("currency"), s["amount_excl"].cast("double").alias("amount_excl_gst"),
        F.when(F.col("ok") % 4 == 1, F.lit(9.0)).when(F.col("ok") % 4 == 2, s["gst"].cast("double")).alias("gst"),
        s["amount_incl"].cast("double").alias("amount_incl_gst"), "is_proforma",
        F.transform("line_items", lambda x: F.struct(
            x["description"].alias("description"), x["qty"].cast("double").alias("qty"),
            x["amount_incl"].cast("double").alias("amount_incl_gst"))).alias("line_items")))
    return inv.select("doc_id", F.when(F.col("ok") % 5 == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
                      .when(F.col("ok") % 5 == 2, F.concat(F.lit("Here is the invoice: "), body, F.lit(" as asked.")))
                      .when(F.col("ok") % 5 == 3, F.concat(F.lit("Sorry "), F.substring(body, 1, 20)))
                      .otherwise(body).alias("response"))


_BUILDERS = {
    "ledger0": _ledger0, "ledger": _ledger, "ledger_raw": _ledger_raw, "vendor": _vendor,
    "invoice_base": _invoice_base, "invoice": _invoice, "rendered": _rendered, "page": _page,
    "ocr_page": _ocr_page, "word": _word, "second_reader": _second_reader,
}
