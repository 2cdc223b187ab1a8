"""The same results in SQL that DuckDB runs on the driver's tables.

The statements share the derivation of the inputs with the queries and nothing else: matching, reports and
rankings are written again, mostly by brute force over all pairs.
"""

from __future__ import annotations

from ledgerloom.operators import outcome_lines as L
from ledgerloom.operators import quality as Q
from ledgerloom.operators import review as R
from ledgerloom.sources import derived as D

_INPUTS = {n: n for n in ("lineitem", "orders", "supplier", "ledger0", "invoice_base")}


def _cte(name: str, sql: str) -> tuple[str, str]:
    return name, sql.format(**_INPUTS)


def _txt(x: str) -> str:
    """Printed amount with one or two decimals."""
    return f"regexp_replace(cast(cast({x} as decimal(30,2)) as varchar), '(\\.\\d)0$', '\\1')"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _fill(template: str, *values: str) -> str:
    parts = template.split("{}")
    out = _q(parts[0])
    for v, p in zip(values, parts[1:]):
        out += f" || {v} || {_q(p)}"
    return out


def _skey(x: str) -> str:
    words = "PTE|LTD|LIMITED|INC|LLC|CO|CORP|SINGAPORE|ASIA"
    return (f"nullif(regexp_replace(regexp_replace(upper({x}), '\\b({words})\\b', '', 'g'), "
            "'[^A-Z0-9]', '', 'g'), '')")


def _dkey(x: str) -> str:
    return f"nullif(regexp_replace(upper({x}), '[^\\p{{L}}\\p{{N}}_\\-/]', '', 'g'), '')"


BASE = [
    _cte("ledger0", D.LEDGER0), _cte("ledger", D.LEDGER), _cte("invoice_base", D.INVOICE_BASE),
    _cte("head", D.INVOICE_HEAD),
    ("inv", """
select *, doc_id as file_order, cast(incl-excl as decimal(18,2)) as gst, ok//7 as seven,
 po_no || '_-_' || coalesce(strftime(invoice_date,'%Y-%m-%d'),'undated')
 || case when is_proforma then ' Proforma Invoice' else ' Tax Invoice' end
 || case when supplier is null or ok%9=4 then '' when ok%3=1 then ' (Tax Invoice copy, '||supplier||')'
    when ok%3=2 then ' ('||supplier||', item 1 out of 3)' else ' ('||supplier||')' end || '.pdf' as source_file,
 case when ocr then (ok//7)%4 else (ok//7)%5 end as form
from head"""),
]
CASCADE = BASE + [
    ("docs", "select doc_id, file_order, invoice_no as k, po_no as po, is_proforma, ocr, incl as total from inv"),
    ("ranked", """select *, row_number() over (partition by k order by file_order desc) as rn,
 min(file_order) over (partition by k) as first_order from docs"""),
    ("prepared", """select r.*, k is not null and rn>1 as is_duplicate,
 is_proforma and k is not null and not (rn>1) and exists (select 1 from docs x where x.po=r.po and not x.is_proforma) as is_superseded
from ranked r"""),
    ("live", "select * from prepared where not is_duplicate and not is_superseded"),
    ("lk", "select invoice_key as k, sum(incl) as s, min(row_no) as first_row from ledger where invoice_key is not null group by 1"),
    ("folds", """select translate(k,'OILSB','01158') as f, min(k) as k, min(s) as s, min(first_row) as first_row
 from lk group by 1 having count(*)=1"""),
    ("tagged", """select v.*, case when e.k is not null then 'number' when f.k is not null then 'folded' end as lvl,
 coalesce(e.k,f.k) as real_key, coalesce(e.s,f.s) as num_incl, case when e.k is null then f.first_row end as fix_row
from live v left join lk e on v.k=e.k
 left join folds f on e.k is null and v.ocr and translate(v.k,'OILSB','01158')=f.f"""),
    ("claims", "select distinct real_key as k from tagged where lvl is not null"),
    ("pool", """select po, count(*) as n_docs, count(total) as n_totals, sum(total) as docs_incl from tagged
 where lvl is null and po is not null and po in (select po_key from ledger) group by po"""),
    ("po_rows", """select po_key as po, count(*) as n_rows, coalesce(sum(incl),0) as rows_incl,
 count(*) filter (where invoice_key is null or invoice_key not in (select k from claims)) as n_free,
 coalesce(sum(incl) filter (where invoice_key is null or invoice_key not in (select k from claims)),0) as free_incl
from ledger where po_key is not null group by 1"""),
    ("decisions", """select *, case when n_docs>=2 and n_totals=n_docs and abs(docs_incl-rows_incl)<=0.05 then 'batch'
 when n_docs>=2 and n_totals=n_docs and n_rows=n_docs then 'pair' else 'rest' end as decision
from pool join po_rows using (po)"""),
]


def _pairing(which: str) -> list[tuple[str, str]]:
    """Greedy pairing, one document per recursion step."""
    return [
        ("pair_docs", f"""select po, list(struct_pack(t := total, doc := doc_id)
  order by total, k is null, first_order, file_order) as docs from tagged
 where lvl is null and po in (select po from decisions where {which}) group by po"""),
        ("pair_rows", f"""select po_key as po, list(struct_pack(r := row_no, a := incl) order by row_no) as rws
 from ledger where po_key in (select po from decisions where {which}) group by 1"""),
        ("steps", """select po, 0 as i, docs, rws, cast(null as bigint) as doc, cast(null as bigint) as r, cast(null as decimal(18,2)) as a
 from pair_docs join pair_rows using (po)
union all
select po, i+1, docs, list_filter(rws, lambda x: x.r <> b.r), docs[i+1].doc, b.r, b.a
from (select *, list_sort(list_transform(rws, lambda x: struct_pack(d := abs(x.a - docs[i+1].t), r := x.r, a := x.a)))[1] as b
      from steps where i < len(docs))"""),
        ("pairs", "select doc as doc_id, r as row_no, a as incl from steps where i>0"),
    ]


VERDICTS = CASCADE + _pairing("decision='pair'") + [
    ("settled", """select t.*, d.n_docs, d.docs_incl, p.row_no as pair_row, d.decision,
 case when lvl is not null then lvl when decision='batch' then 'order_batch' when decision='pair' then 'order_pair'
  when decision='rest' and n_free=0 then 'order_claimed' when decision='rest' and n_free=n_rows then 'order'
  when decision='rest' then 'order_rest' end as match_level,
 case when lvl is not null then num_incl when decision='pair' then p.incl
  when decision='rest' and n_free>0 then free_incl else rows_incl end as ledger_incl
from tagged t left join decisions d on t.lvl is null and t.po=d.po left join pairs p on t.doc_id=p.doc_id"""),
    ("verdicts", """select *, cast(total-ledger_incl as decimal(28,2)) as diff,
 case when match_level is null then 'invoice_only' when decision='batch' then 'matched' when total is null then 'discrepancy'
  when abs(ledger_incl-total)<=0.05 then 'matched' else 'discrepancy' end as outcome from settled"""),
    ("unused", """select l.*, case when status in ('Order Complete','Delivered','Partial Delivered','Pending Payment')
  then 'ledger_only' else 'still_pending' end as outcome from ledger l
 where (invoice_key is null or invoice_key not in (select k from claims))
 and (po_key is null or po_key not in (select po from decisions))"""),
]

_ORDER_NOTE = "case match_level " + " ".join(f"when '{k}' then {_q(v)}" for k, v in L.BY_ORDER.items()) + " end"
_TAG = (f"case match_level when 'number' then '' when 'folded' then {_fill(L.BY_FOLD, 'k', 'real_key')} "
        f"when 'order_batch' then {_fill(L.BY_BATCH, 'cast(n_docs as varchar)', _txt('docs_incl'), _txt('total'))} "
        f"when 'order_pair' then {_fill(L.BY_PAIR, 'cast(n_docs as varchar)')} "
        f"else {_ORDER_NOTE} || case when k is null then {_q(L.KEYLESS)} else '' end end")
_PROBLEM = (f"case when outcome='discrepancy' then "
            f"{_fill(L.MISMATCH, _txt('ledger_incl'), _txt('total'), _txt('diff'))} end")
_HINT = (f"case when regexp_matches(po, '^PO1997') then {_q(L.PRIOR_PERIOD.format('1997'))} else {_q(L.NO_MATCH)} end")

LINES = VERDICTS + [
    ("noted", f"select *, concat_ws('; ', nullif({_TAG},''), {_PROBLEM}) as note from verdicts where match_level is not null"),
    ("both_pairs", """
select n.*, l.row_no as line_no from noted n join ledger l on n.match_level in ('number','folded') and l.invoice_key=n.real_key
union all select n.*, l.row_no from noted n join ledger l on n.match_level in ('order_batch','order_claimed') and l.po_key=n.po
union all select n.*, l.row_no from noted n join ledger l on n.match_level in ('order','order_rest') and l.po_key=n.po
  and (l.invoice_key is null or l.invoice_key not in (select k from claims))
union all select n.*, l.row_no from noted n join ledger l on n.match_level='order_pair' and l.row_no=n.pair_row"""),
    ("merged", """select coalesce(f.invoice_number, i.invoice_no) as invoice_number, i.po_no as po_number,
 coalesce(i.supplier, l.supplier) as supplier, coalesce(i.invoice_date, l.invoice_date) as invoice_date,
 coalesce(i.due_date, l.due_date) as due_date, l.description, l.unit_no, 'SGD' as currency, l.unit_price, l.excl, l.gst, l.incl,
 'Both' as source, b.note, b.outcome, b.match_level, b.doc_id, b.line_no, i.source_file
from both_pairs b join inv i on b.doc_id=i.doc_id join ledger l on l.row_no=b.line_no left join ledger f on f.row_no=b.fix_row"""),
    ("alone", f"""select i.invoice_no as invoice_number, i.po_no as po_number, i.supplier, i.invoice_date, i.due_date,
 case when i.ok%2=0 then 'Goods of '||i.po_no end as description, case when i.ok%2=0 then i.qty end as unit_no, 'SGD' as currency,
 cast(null as decimal(18,2)) as unit_price, i.excl, i.gst, i.incl, 'PDF' as source,
 {_HINT} || case when i.ok%2=0 then '' else {_q('; ' + L.TOTAL_ONLY)} end as note, v.outcome,
 cast(null as varchar) as match_level, v.doc_id, 0 as line_no, i.source_file
from verdicts v join inv i on v.doc_id=i.doc_id where v.outcome='invoice_only'"""),
    ("ledger_lines", f"""select invoice_number, po_number, supplier, invoice_date, due_date, description, unit_no, currency,
 unit_price, excl, gst, incl, 'Excel' as source, {_q(L.LEDGER_ONLY)} as note, outcome, cast(null as varchar) as match_level,
 cast(null as bigint) as doc_id, row_no as line_no, cast(null as varchar) as source_file from unused where outcome='ledger_only'"""),
    ("lines", "select * from merged union all select * from alone union all select * from ledger_lines"),
]
_LINE_COLS = ("invoice_number, po_number, supplier, cast(invoice_date as varchar) as invoice_date, "
              "cast(due_date as varchar) as due_date, description, cast(unit_no as double) as unit_no, currency, "
              "cast(unit_price as double) as unit_price, cast(excl as double) as excl, cast(gst as double) as gst, "
              "cast(incl as double) as incl, source, note")

RUNS = LINES + [
    ("placed", "select *, coalesce(doc_id, line_no) as place from lines"),
    ("marked", """select *, case when row_number() over w = 1 or lag(invoice_number) over w is distinct from invoice_number
 or lag(po_number) over w is distinct from po_number or lag(note) over w is distinct from note then 1 else 0 end as st
 from placed window w as (partition by outcome order by place, line_no)"""),
]

CLEAN = [
    _cte("ledger0", D.LEDGER0), _cte("ledger_raw", D.LEDGER_RAW), _cte("vendor", D.VENDOR),
    ("named", "select trim(vendor) as canonical, brands, row_no from vendor where trim(vendor)<>''"),
    ("alias_all", f"""select {_skey('canonical')} as alias_key, canonical, 0 as tier, -row_no as r, 0 as pos from named
 union all select {_skey('b.brand')}, canonical, 1, row_no, b.pos from (
  select canonical, row_no, unnest(regexp_split_to_array(brands,'[,，/]')) as brand,
   generate_subscripts(regexp_split_to_array(brands,'[,，/]'),1) as pos from named where brands is not null) b"""),
    ("aliases", """select alias_key, canonical from (select *, row_number() over (partition by alias_key order by tier, r, pos) as rn
 from alias_all where alias_key is not null) where rn=1"""),
    ("clean0", f"""select r.*, coalesce(a.canonical, ordered_from, brand) as supplier from ledger_raw r
 left join aliases a on a.alias_key={_skey('coalesce(ordered_from, brand)')} where status is not null"""),
    ("clean", f"""select invoice_number, po_number, supplier, invoice_date,
 invoice_date + try_cast(nullif(regexp_extract(notes,'(?i)(\\d+)\\s*Days',1),'') as integer) as due_date,
 item_description as description, units as unit_no, cast(null as varchar) as currency, unit_cost as unit_price,
 cast(round(unit_cost*units,2) as decimal(18,2)) as excl,
 cast(round(total_cost-unit_cost*units,2) as decimal(18,2)) as gst, total_cost as incl,
 {_dkey('invoice_number')} as invoice_key, {_dkey('po_number')} as po_key, {_skey('supplier')} as supplier_key, status, row_no
from clean0"""),
]

# Similarity by plain dynamic programming over all pairs of distinct names. A row of the table is a list;
# each cell is the larger of the cell above, the diagonal plus a match, and the cell before.
_LCS = ("list_last(list_reduce(list_prepend(list_transform(range(0, len({b})+1), lambda z: 0), "
        "list_transform(string_split({a},''), lambda ch: [ascii(ch)])), "
        "lambda prev, ch: list_reduce(list_prepend([0], list_transform(range(1, len({b})+1), lambda j: "
        "[greatest(prev[j+1], prev[j] + case when ascii(substr({b}, cast(j as integer), 1)) = ch[1] then 1 else 0 end)])), "
        "lambda row, c: list_append(row, greatest(list_last(row), c[1])))))")


def _lcs(a: str, b: str) -> str:
    return _LCS.format(a=a, b=b)


SIMILAR = CASCADE + [
    ("inv_names", f"select distinct {_skey('supplier')} as name from inv where supplier is not null"),
    ("led_names", "select supplier_key as name, min(row_no) as first_row from ledger group by 1"),
    ("name_pairs", "select a.name as left_name, b.name as right_name from inv_names a, led_names b"),
    ("sided", """select *, case when length(left_name)<=length(right_name) then left_name else right_name end as s,
 case when length(left_name)<=length(right_name) then right_name else left_name end as t from name_pairs"""),
    ("windows", """select left_name, right_name, s as x, substr(t, greatest(1, cast(e as integer)-length(s)+1),
  least(cast(e as integer), length(t)) - greatest(1, cast(e as integer)-length(s)+1) + 1) as y
 from sided, range(1, 40) as g(e) where e < length(s)+length(t)
 union all select left_name, right_name, t, substr(s, greatest(1, cast(e as integer)-length(t)+1),
  least(cast(e as integer), length(s)) - greatest(1, cast(e as integer)-length(t)+1) + 1)
 from sided, range(1, 40) as g(e) where e < length(s)+length(t) and length(s)=length(t)
 union all select left_name, right_name, s, t from sided"""),
    ("scored", f"""select left_name, right_name, max(200.0 * ({_lcs('x', 'y')}) / (length(x)+length(y))) as similarity
 from (select * from windows where length(y) > 0 and 200.0*least(length(x),length(y))/(length(x)+length(y)) >= 85) group by 1,2"""),
    ("sim_pairs", "select * from scored where similarity >= 85"),
    ("baseline_of", """select left_name as name, arg_min(right_name, first_row) as baseline_key
 from sim_pairs join led_names on right_name=led_names.name group by 1"""),
]


def build(ctes: list[tuple[str, str]], final: str) -> str:
    return "with recursive " + ",\n".join(f"{n} as ({q})" for n, q in ctes) + "\n" + final


_FMT3 = "form=3"
ORACLES: dict[str, str] = {
    "ledger_clean": build(CLEAN, """select invoice_number, po_number, supplier, cast(invoice_date as varchar) as invoice_date,
 cast(due_date as varchar) as due_date, description, cast(unit_no as double) as unit_no, currency,
 cast(unit_price as double) as unit_price, cast(excl as double) as excl, cast(gst as double) as gst, cast(incl as double) as incl,
 invoice_key, po_key, supplier_key, status, row_no from clean"""),
    "vendor_alias": build(CLEAN, "select alias_key, canonical from aliases"),
    "reconcilable_split": build(CLEAN, """select case when invoice_key is null and po_key is null then 'pending' else 'expected' end as part,
 status, count(*) as n, count(distinct invoice_key) as n_numbers, cast(sum(incl) as double) as incl from clean group by 1,2"""),
    "key_normalize": build(CLEAN, f"""select row_no, {_dkey('invoice_number')} as invoice_key, {_dkey('po_number')} as po_key,
 {_skey('ordered_from')} as supplier_key, translate({_dkey('invoice_number')},'OILSB','01158') as fold,
 invoice_number is not null as valid from ledger_raw"""),
    "number_shape": build(BASE, """select coalesce(regexp_replace(regexp_replace(trim(invoice_no),'\\d','9','g'),'[A-Za-z]','A','g'),'') as shape,
 count(*) as n from inv group by 1"""),
    "identifier_print": """select case when v=floor(v) then cast(cast(v as bigint) as varchar) else cast(v as varchar) end as identifier,
 count(*) as n from (select l_quantity * case when l_linenumber=1 then 0.5 else 1.0 end as v from lineitem) t group by 1""",
    "exact_match_verdict": build(CASCADE, """select doc_id, cast(total as double) as total, cast(s as double) as ledger_incl,
 case when lk.k is null then 'no_exact_key' when abs(s-total)<=0.05 then 'matched' else 'discrepancy' end as verdict
 from docs left join lk on docs.k=lk.k"""),
    "dedupe_last": build(CASCADE, "select doc_id, is_duplicate from prepared"),
    "duplicate_invoice": build(CASCADE, """select p.doc_id, invoice_no, po_no, supplier, cast(incl as double) as total, source_file
 from prepared p join inv i on p.doc_id=i.doc_id where is_duplicate"""),
    "superseded_proforma": build(CASCADE, f"""select p.doc_id, invoice_no, po_no, supplier, cast(incl as double) as total,
 {_q(L.SUPERSEDED)} as reason, source_file from prepared p join inv i on p.doc_id=i.doc_id where is_superseded"""),
    "fold_unique_match": build(CASCADE, """select doc_id, k as invoice_key, real_key, cast(num_incl as double) as ledger_incl
 from tagged where lvl='folded'"""),
    "po_pool": build(CASCADE, """select po as po_key, n_docs, cast(docs_incl as double) as docs_incl, n_rows, cast(rows_incl as double) as rows_incl,
 n_free, cast(free_incl as double) as free_incl, decision from decisions"""),
    "po_nearest_pair": build(CASCADE + _pairing("n_docs>=2 and n_rows=n_docs and n_totals=n_docs"),
                             "select doc_id, row_no, cast(incl as double) as incl from pairs"),
    "invoice_only": build(VERDICTS, f"select doc_id, {_HINT} as note from verdicts where outcome='invoice_only'"),
    "outcome_counts": build(VERDICTS, """select outcome, coalesce(match_level,'none') as level, count(*) as n, cast(sum(total) as double) as total
 from verdicts group by 1,2 union all select outcome, 'ledger', count(*), cast(sum(incl) as double) from unused group by 1"""),
    "merged_lines": build(LINES, f"select {_LINE_COLS}, outcome, match_level, doc_id, line_no from merged"),
    "ledger_link_groups": build(VERDICTS, """select 'number:'||invoice_key as group_key, row_no from ledger where invoice_key in (select k from claims)
 union all select 'order:'||po_key, row_no from ledger where po_key in (select po from decisions where decision='batch' or (decision='rest' and n_free=0))
 union all select 'free:'||po_key, row_no from ledger where po_key in (select po from decisions where decision='rest' and n_free>0)
  and (invoice_key is null or invoice_key not in (select k from claims))
 union all select 'row:'||row_no, row_no from pairs"""),
    "pdf_lines": build(LINES, f"select {_LINE_COLS}, outcome, doc_id, line_no from alone"),
    "contiguous_groups": build(RUNS, """select outcome, doc_id, line_no,
 cast(sum(st) over (partition by outcome order by place, line_no) as bigint) as run_no, st=1 as starts_run from marked"""),
    "group_runs": build(RUNS, """select outcome, run_no, count(*) as n_lines, max(case when st=1 then doc_id end) as doc_id,
 max(case when st=1 then line_no end) as line_no from (
  select *, cast(sum(st) over (partition by outcome order by place, line_no) as bigint) as run_no from marked) group by outcome, run_no"""),
    "kpi": build(RUNS, """select (select count(*) from prepared where k is not null and not is_duplicate and not is_superseded) as invoices_read,
 (select count(*) from (select distinct invoice_number from lines where outcome='matched')) as matched,
 (select cast(sum(st) as bigint) from marked where outcome='discrepancy') as amount_mismatch,
 (select cast(sum(st) as bigint) from marked where outcome='invoice_only') as no_ledger_match,
 (select count(*) from lines where outcome='ledger_only') as no_invoice_found"""),
    "payables_export": build(LINES, """select doc_id, line_no, invoice_number, po_number, supplier,
 coalesce(strftime(invoice_date,'%d/%m/%Y'),'') as invoice_date,
 coalesce(strftime(due_date,'%d/%m/%Y'), strftime(invoice_date,'%d/%m/%Y'), '') as due_date, description,
 cast(unit_no as double) as unit_no, currency, cast(unit_price as double) as unit_price, cast(excl as double) as excl,
 cast(gst as double) as gst, cast(incl as double) as incl, source, note from lines where outcome='matched'"""),
    "display_text": build(LINES, """select source, coalesce(currency,'') as currency, coalesce(cast(due_date as varchar),'') as due_date, count(*) as n,
 max(coalesce(regexp_replace(cast(incl as varchar),'\\.?0+$',''),'')) as max_incl, min(coalesce(description,'')) as first_description from lines group by 1,2,3"""),
    "pending_rows": build(VERDICTS + CLEAN[1:], """select invoice_number, po_number, supplier, description, cast(unit_no as double) as unit_no,
 cast(incl as double) as incl, status, row_no from clean where invoice_key is null and po_key is null
 union all select invoice_number, po_number, supplier, description, cast(unit_no as double), cast(incl as double), status, row_no
 from unused where outcome='still_pending'"""),
    "warnings_report": build(CASCADE, """select doc_id, coalesce(new_no, invoice_no, source_file) as document,
 concat_ws('; ', unread, changed) as warnings from (
  select i.doc_id, i.invoice_no, i.source_file, l.invoice_number as new_no,
   case when i.invoice_no is null then 'No invoice number was read, so the document cannot be matched by it' end as unread,
   case when l.invoice_number is distinct from i.invoice_no and l.invoice_number is not null then
    'The ledger''s number ' || l.invoice_number || ' is used in place of ' || coalesce(i.invoice_no, '')
    || ', which only differs by letters that look alike' end as changed
  from tagged t join inv i on t.doc_id=i.doc_id left join ledger l on t.lvl='folded' and l.row_no=t.fix_row)
 where unread is not null or changed is not null"""),
    "override_apply": build(LINES, f"""select outcome||case when doc_id is not null then ':doc:' else ':row:' end||coalesce(doc_id,line_no) as group_id, line_no,
 case when moved then 'matched' else outcome end as outcome, case when moved then outcome end as from_outcome,
 cast(invoice_date as varchar) as invoice_date, case when moved then null else cast(due_date as varchar) end as due_date,
 case when moved then null else cast(unit_no as double) end as unit_no, cast(excl as double) as excl,
 case when moved then null else cast(gst as double) end as gst, cast(incl as double) as incl,
 case when not moved then note when outcome='pending' then {_q(R.MOVED_PENDING)}
  {" ".join(f"when outcome='{o}' then {_q(x)} || coalesce(note, '') || {_q(y)}" for o, (x, y) in R.MOVED.items())} end as note,
 case when moved then 'unit_no' end as rejected
from (select *, outcome='discrepancy' and coalesce(match_level,'')='number' or outcome='invoice_only'
  or outcome in ('ledger_only','pending') and coalesce(incl >= 40000, false) as moved
 from (select * from lines union all select invoice_number, po_number, supplier, invoice_date, due_date, description, unit_no,
  currency, unit_price, excl, gst, incl, 'Excel', cast(null as varchar), 'pending', cast(null as varchar),
  cast(null as bigint), row_no, cast(null as varchar) from unused where outcome='still_pending'))"""),
    "supplier_baseline": build(BASE, """select supplier_key, first_row, n_values, median, n_shapes, first_shapes from
 (select supplier_key, min(row_no) as first_row, count(incl) as n_values, round(median(cast(incl as double)),3) as median from ledger group by 1)
 join (select supplier_key, count(*) as n_shapes, array_to_string(list(shape order by shape)[1:3],' | ') as first_shapes from
  (select distinct supplier_key, coalesce(regexp_replace(regexp_replace(invoice_number,'\\d','9','g'),'[A-Za-z]','A','g'),'') as shape from ledger) group by 1)
 using (supplier_key)"""),
    "repair_suggest": build(BASE, f"""
, asked as (select distinct ledger_supplier as sk, unnest([invoice_no, regexp_extract(invoice_no,'^(.*)-[^-]*$',1)]) as num from inv where invoice_no is not null),
nums as (select distinct supplier_key as sk, trim(invoice_number) as other from ledger where invoice_number is not null),
cls as (select sk, num, other, len(list_filter(range(1,length(num)+1), lambda j: upper(substr(num,cast(j as integer),1))<>upper(substr(other,cast(j as integer),1)))) as nd,
  len(list_filter(range(1,length(num)+1), lambda j: upper(substr(num,cast(j as integer),1))<>upper(substr(other,cast(j as integer),1)) and
   not list_contains(['O0','0O','I1','1I','L1','1L','S5','5S','B8','8B','Z2','2Z','G6','6G','Q0','0Q','D0','0D'],
   upper(substr(num,cast(j as integer),1))||upper(substr(other,cast(j as integer),1))))) as nbad
  from asked join nums using (sk) where num<>other and length(num)=length(other)),
hits as (select sk, num, array_to_string(list(other order by other)[1:3],' / ') as t from cls where nd between 1 and 3 and nbad=0 group by 1,2),
pre as (select sk, num, array_to_string(list(other order by other)[1:3],' / ') || case when count(*)>3 then '...' else '' end as t
  from asked join nums using (sk) where num<>other and length(num)>=4 and starts_with(other,num) group by 1,2)
select sk as supplier_key, num as number, coalesce({_q(Q.MISREAD)}||hits.t, {_q(Q.TRUNCATED)}||pre.t) as suggestion
from hits full join pre using (sk,num)""").replace("\n\n, asked", ",\nasked"),
    "similar_suppliers": build(SIMILAR, "select left_name, right_name, cast(similarity as double) as similarity from sim_pairs"),
    "first_similar_supplier": build(SIMILAR, "select name, baseline_key from baseline_of"),
    "file_kinds": build(BASE, """select unnest(['invoice','ledger','other']) as kind, unnest([2*count(*), 2*count(*), count(*)]) as n from inv"""),
    "filename_parse": build(BASE, """select doc_id, po_no as name_po, cast(invoice_date as varchar) as name_date,
 case when supplier is null or ok%9=4 then null else supplier end as name_supplier, cast(null as varchar) as name_number,
 is_proforma as name_proforma from inv"""),
    "scan_detect": build(BASE, """select doc_id, case when ok%3=0 and not ocr then 2 else 1 end as n_pages, ocr as is_scanned from inv"""),
    "scan_detect_documents": """select doc_id, 1 as n_pages, length(regexp_replace(regexp_replace(coalesce(text,''),'^\\s+',''),'\\s+$','')) < 40 as is_scanned from documents""",
}

for _name, _levels in {"po_batch_match": "('order_batch')", "po_remainder_match": "('order','order_rest','order_claimed')",
                       "document_verdicts": None}.items():
    ORACLES[_name] = build(VERDICTS, """select doc_id, match_level, cast(ledger_incl as double) as ledger_incl,
 cast(total as double) as total, cast(diff as double) as diff, outcome from verdicts""" + (
        f" where match_level in {_levels}" if _levels else ""))
for _name in ("ledger_only", "still_pending"):
    ORACLES[_name] = build(VERDICTS, f"select row_no, status, cast(incl as double) as incl from unused where outcome='{_name}'")

# --- quality and candidates -----------------------------------------------------------------------

_SHAPE = "coalesce(regexp_replace(regexp_replace({x},'\\d','9','g'),'[A-Za-z]','A','g'),'')"
_PAIRS = "['O0','0O','I1','1I','L1','1L','S5','5S','B8','8B','Z2','2Z','G6','6G','Q0','0Q','D0','0D']"
_AT = "upper(substr({x},cast(j as integer),1))"
_N, _O = _AT.format(x="num"), _AT.format(x="other")

QUALITY = VERDICTS + SIMILAR[len(CASCADE):] + [
    ("shapes", f"select distinct supplier_key as sk, {_SHAPE.format(x='invoice_number')} as shape from ledger"),
    ("history", """select supplier_key as sk, count(incl) as n_values, median(cast(incl as double)) as med from ledger group by 1"""),
    ("shown", "select sk, count(*) as n_shapes, array_to_string(list(shape order by shape)[1:3],'/') as first_shapes from shapes group by 1"),
    ("q0", f"""select v.doc_id, v.ocr, v.is_proforma, i.supplier, i.invoice_date, i.excl as e, i.gst as g, i.incl as i, b.baseline_key as sk,
 coalesce(f.invoice_number, i.invoice_no) as num, {_SHAPE.format(x='coalesce(f.invoice_number, i.invoice_no)')} as shape
 from verdicts v join inv i on v.doc_id=i.doc_id left join ledger f on f.row_no=v.fix_row
 left join baseline_of b on b.name={_skey('i.supplier')}"""),
    ("q1", """select q0.*, n_values, med, first_shapes, n_shapes>0 and not is_proforma
  and not exists (select 1 from shapes s where s.sk=q0.sk and s.shape=q0.shape) as odd
 from q0 left join history h on h.sk=q0.sk left join shown s on s.sk=q0.sk"""),
    ("asked", "select distinct sk, num from q1 where odd and num is not null"),
    ("nums", "select distinct supplier_key as sk, invoice_number as other from ledger where invoice_number is not null"),
    ("cls", f"""select sk, num, other, len(list_filter(range(1,length(num)+1), lambda j: {_N}<>{_O})) as nd,
 len(list_filter(range(1,length(num)+1), lambda j: {_N}<>{_O} and not list_contains({_PAIRS}, {_N}||{_O}))) as nbad
 from asked join nums using (sk) where num<>other and length(num)=length(other)"""),
    ("hits", "select sk, num, array_to_string(list(other order by other)[1:3],' / ') as t from cls where nd between 1 and 3 and nbad=0 group by 1,2"),
    ("pre", """select sk, num, array_to_string(list(other order by other)[1:3],' / ') || case when count(*)>3 then '...' else '' end as t
 from asked join nums using (sk) where num<>other and length(num)>=4 and starts_with(other,num) group by 1,2"""),
    ("flags", f"""select doc_id, list_filter([
  case when n_values>=3 and med>0 and (i*10<med or i>med*10) then {_fill("Amount {} is more than 10x off this supplier's median of {}", _txt('i'), _txt('round(cast(med as decimal(18,3)),2)'))} end,
  case when odd then {_fill("Invoice number format {} doesn't match this supplier's ledger formats ({})", 'shape', 'first_shapes')}
   || coalesce('; '||coalesce({_q(Q.MISREAD)}||hits.t, {_q(Q.TRUNCATED)}||pre.t), '') end,
  case when invoice_date is null then {_q(Q.NO_DATE)} end,
  case when abs(e+g-i)>0.05 then {_q(Q.UNEQUAL)} end,
  case when i>0 and e<>0 and not (i-e>=0 and i-e<i*0.15) then 'Unusual tax rate: '||cast(round(cast((i-e) as double)/cast(i as double)*100,1) as varchar)||'%' end,
  case when ocr then {_q(Q.BY_OCR)} end,
  case when supplier is null then {_q(Q.NO_SUPPLIER)} end], lambda x: x is not null) as reasons
 from q1 left join hits on odd and hits.sk=q1.sk and hits.num=q1.num left join pre on odd and pre.sk=q1.sk and pre.num=q1.num"""),
]
ORACLES["quality_flags"] = build(QUALITY, "select doc_id, array_to_string(reasons,' | ') as quality_flags from flags")
_FLAGGED = QUALITY + LINES[len(VERDICTS):]
ORACLES["flagged_documents"] = build(_FLAGGED, """select outcome, label, arg_min(array_to_string(reasons,' | '), doc_id) as quality_flags from (
 select *, coalesce(invoice_number,'(number not recognized)')||' · '||coalesce(supplier,'None')||' · '||source_file as label
 from lines join flags using (doc_id) where len(reasons)>0) group by 1,2""")
ORACLES["highlight_counts"] = build(_FLAGGED, """select outcome, coalesce(len(reasons),0)>0 as flagged, count(*) as n
 from lines left join flags using (doc_id) group by 1,2""")
ORACLES["candidate_topk"] = build(VERDICTS + SIMILAR[len(CASCADE):] + [
    ("groups", """select invoice_key, coalesce(sum(incl),0) as amount, arg_min(supplier_key,row_no) as sk, arg_min(supplier,row_no) as sup,
 arg_min(invoice_number,row_no) as num, arg_min(invoice_date,row_no) as d from ledger where invoice_key is not null group by 1"""),
    ("scored_all", f"""select v.doc_id, num as invoice_number, sup as ledger_supplier, d as ledger_date, amount, invoice_key,
 cast(amount-v.total as decimal(18,2)) as amount_diff, abs(date_diff('day', d, i.invoice_date)) as date_gap, similarity
 from verdicts v join inv i on v.doc_id=i.doc_id join sim_pairs s on s.left_name={_skey('i.supplier')} join groups g on g.sk=s.right_name
 where v.outcome='invoice_only' and v.k is not null"""),
    ("best", """select *, row_number() over (partition by doc_id order by score desc, invoice_key) as rank from (
 select *, cast(coalesce(greatest(60-abs(amount_diff),0),0) + coalesce(greatest(30-date_gap,0),0) as double) + similarity*0.1 as score from scored_all)"""),
], """select doc_id, rank, invoice_number, ledger_supplier, cast(ledger_date as varchar) as ledger_date, cast(amount as double) as amount,
 cast(amount_diff as double) as amount_diff, date_gap, score from best where rank<=5""")

# --- reading texts: the values the texts were printed from -----------------------------------------

_DUE = "case when form in (0,1,4) then cast(due_date as varchar) end"
_CUR = "case when form=1 then 'USD' else 'SGD' end"
_LETTERHEAD = "case when supplier is not null then ledger_supplier||' Pte Ltd' end"
_MONEY = "format('{:,.2f}', cast(%s as double))"
_DMY = "strftime(%s,'%%d/%%m/%%Y')"

ORACLES["header_extract"] = build(BASE, f"""select doc_id, invoice_no, cast(invoice_date as varchar) as invoice_date, {_DUE} as due_date, po_no,
 {_LETTERHEAD} as supplier, {_CUR} as currency, case when form=4 then '30 Days' end as terms from inv""")
ORACLES["currency_detect"] = build(BASE, f"select doc_id, {_CUR} as currency from inv")
ORACLES["label_below"] = build(BASE, f"""select doc_id,
 case when invoice_no is null then null when form=0 then case when invoice_date is not null then 'Invoice' when due_date is not null then 'Due' else 'PO' end
  when form=1 then case when due_date is not null then 'Due' when invoice_date is not null then 'Date' else 'Your' end
  when form=3 then invoice_no end as below_no,
 case when invoice_date is null then null when form=0 then case when due_date is not null then 'Due' else 'PO' end
  when form=2 then 'Reference' when form=3 then {_DMY % 'invoice_date'} end as below_day,
 case form when 1 then 'Terms' when 2 then 'Untaxed' when 3 then po_no end as below_po,
 case when due_date is null then null when form=0 then 'PO' when form=1 then case when invoice_date is not null then 'Date' else 'Your' end end as below_due,
 case form when 1 then 'GST' when 3 then {_MONEY % 'incl'} end as below_total from inv""")
ORACLES["table_kv"] = build(BASE, """select doc_id, e.k as key, e.v as value from (select doc_id, unnest([
 struct_pack(k:='invoice no', v:=invoice_no), struct_pack(k:='invoice date', v:=cast(invoice_date as varchar)), struct_pack(k:='po no', v:=po_no),
 struct_pack(k:='due date', v:=cast(due_date as varchar)), struct_pack(k:='terms', v:='30 Days')]) as e from inv where form=4) where e.v is not null""")
ORACLES["item_table"] = build(BASE, """select doc_id, cast(excl as double) as excl, cast(gst as double) as gst, cast(incl as double) as incl,
 case when ok%2=0 then 'Goods of '||po_no end as description, case when ok%2=0 then cast(qty as double) end as qty,
 case when ok%2=0 then cast(incl as double) end as item_incl from inv where form=4""")
ORACLES["totals_extract"] = build(BASE, """select doc_id, case when form<3 then cast(excl as double) end as t_excl,
 case when form<3 then cast(gst as double) end as t_gst, case when form<3 then cast(incl as double) end as t_incl from inv""")
ORACLES["totals_algebra"] = build(BASE, """
, a as (select row_no, cast(case when row_no%13 in (0,1,2) then null when row_no%13=3 then -excl when row_no%13=4 then incl else excl end as decimal(18,2)) as e,
 cast(case when row_no%13 in (0,4,5) then null when row_no%13=6 then 9 else incl-excl end as decimal(18,2)) as g,
 cast(case when row_no%13 in (1,7) then null when row_no%13=8 then 0 else incl end as decimal(18,2)) as i from ledger0),
b as (select row_no, case when e is null and g is null and i is not null then i else e end as e,
 case when g is null and i is not null and (e is null or abs(e-i)<=0.01) then 0 else g end as g, i from a),
c as (select row_no, e, case when abs(e+g-i)>0.05 then i-e else g end as g, i from b),
d as (select row_no, case when e>0 then e end as e, case when coalesce(e<=0,false) or coalesce(i<=0,false) then null else g end as g, case when i>0 then i end as i from c)
select row_no, cast(coalesce(e,i-g) as double) as e, cast(coalesce(g,i-e) as double) as g, cast(coalesce(i,e+g) as double) as i from d""").replace("\n\n, a as", ",\na as")

_PAD = "coalesce(rpad(%s,24,' '),'')"
_F3_HEADS = " || ".join(_PAD % x for x in ("case when invoice_no is not null then 'Invoice Number' end",
                                           "case when invoice_date is not null then 'Invoice Date' end", "'Reference'"))
_F3_VALUES = " || ".join(_PAD % x for x in ("invoice_no", _DMY % "invoice_date", "po_no"))
_E, _G, _I = (_MONEY % x for x in ("excl", "gst", "incl"))
ORACLES["layout_rebuild"] = build(BASE, f"""select doc_id, 1 as page_no, array_to_string(list_transform(list_filter(case form
 when 0 then [{_LETTERHEAD}, 'TAX INVOICE', 'Invoice No: '||invoice_no, 'Invoice Date: '||{_DMY % 'invoice_date'}, 'Due Date: '||{_DMY % 'due_date'},
  'PO No: '||po_no, 'Subtotal '||{_E}, 'GST 9% '||{_G}, 'Total SGD '||{_I}]
 when 1 then [{_LETTERHEAD}, 'Invoice Number '||invoice_no, 'Due Date: '||{_DMY % 'due_date'}, 'Date: '||cast(invoice_date as varchar), 'Your Ref: '||po_no,
  'Terms of delivery on request', 'TOTAL EXCL. GST '||{_E}, 'GST 9% '||{_G}, 'TOTAL USD '||{_I}]
 when 2 then [{_LETTERHEAD}, coalesce('Tax Invoice '||invoice_no, 'Tax Invoice'), 'Invoice Date: '||strftime(invoice_date,'%-d %B %Y'), 'Reference '||po_no,
  'Untaxed Amount S$ '||{_E}, 'TAX 9% S$ '||{_G}, 'Total S$ '||{_I}||' .']
 when 3 then [{_LETTERHEAD}, {_F3_HEADS}, {_F3_VALUES}, 'Items Sub-Total '||{_E}, repeat(' ',40)||'TOTAL CURRENCY', repeat(' ',40)||{_I}||' SGD']
 else [{_LETTERHEAD}, 'TAX INVOICE', 'Goods supplied as listed in the schedule below', 'Currency SGD', 'Thank you for the order placed with our company'] end,
 lambda x: x is not null), lambda x: rtrim(x)), chr(10)) as layout_text from inv""")
ORACLES["json_second_reader"] = build(BASE, """select doc_id, ok%5<>3 as valid, case when ok%5<>3 then invoice_no end as invoice_no,
 case when ok%5<>3 then cast(invoice_date as varchar) end as invoice_date, case when ok%5<>3 then supplier end as supplier,
 case when ok%5<>3 then cast(excl as double) end as excl,
 case when ok%5<>3 then cast(case when ok%4=1 and abs(excl+9-incl)<=0.05 then 9 else gst end as double) end as gst,
 case when ok%5<>3 then cast(incl as double) end as incl, case when ok%5<>3 then case when ok%2=0 then 1 else 0 end end as n_items from inv""")
_READ = "(ocr or invoice_no is null) and ok%5<>3"
ORACLES["invoice_extract"] = build(BASE, f"""select doc_id, source_file, invoice_no, po_no, supplier,
 case when supplier is not null and ok%9<>4 then ledger_supplier||' Pte Ltd' end as supplier_from_body, {_CUR} as currency,
 cast(invoice_date as varchar) as invoice_date, {_DUE} as due_date, is_proforma, ocr, case when form<>3 then cast(excl as double) end as excl,
 case when form<>3 then cast(gst as double) end as gst, cast(incl as double) as incl, case when form=4 and ok%2=0 then 1 else 0 end as n_items from inv""")
ORACLES["second_reader_merge"] = build(BASE, f"""select doc_id, invoice_no, cast(invoice_date as varchar) as invoice_date, supplier,
 {_READ} and not is_proforma as second_reader, cast(incl as double) as incl,
 case when ok%2=0 and (form=4 or ({_READ})) then 1 else 0 end as n_items from inv""")
ORACLES["text_to_outcome"] = build(VERDICTS, """select outcome, coalesce(match_level,'none') as level, count(*) as n, cast(sum(total) as double) as total
 from verdicts group by 1,2""")

_SHEET = {**{c: c for c in L.OUT_COLS}, **{c: f"cast({c} as varchar)" for c in ("invoice_date", "due_date")},
          **{c: f"cast({c} as double)" for c in L.MONEY_COLS}}
ORACLES["outcome_sink"] = build(LINES, "select " + ", ".join(
    f'{_SHEET[c]} as "{name}"' for c, name in L.OUT_COLS.items()) + ", outcome from lines")
ORACLES["side_report_sinks"] = build(VERDICTS + CLEAN[1:], """select 'superseded' as report, invoice_no as number, po_no as po, supplier,
 cast(incl as double) as amount, source_file as place from prepared p join inv i on p.doc_id=i.doc_id where is_superseded
 union all select 'pending', invoice_number, po_number, supplier, cast(incl as double), cast(row_no as varchar) from (
  select invoice_number, po_number, supplier, incl, row_no from clean where invoice_key is null and po_key is null
  union all select invoice_number, po_number, supplier, incl, row_no from unused where outcome='still_pending')""")
ORACLES["ledger_quarantine"] = build(CLEAN[:2], """select 'good' as part, count(*) as n, cast(sum(row_no) as bigint) as rows_sum,
 cast(sum(total_cost) as double) as total, count(distinct invoice_number) as n_numbers, count(invoice_date) as n_dates
 from ledger_raw where row_no%89 not in (5,7,9) having count(*)>0
 union all select case when row_no%89=9 then 'no row_no' else 'unreadable' end, count(*), null, null, null, null
 from ledger_raw where row_no%89 in (5,7,9) group by 1""")
