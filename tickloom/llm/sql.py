"""Independent SQL (DuckDB) for the queries of this subpackage that SQL can express."""

_WORDS = r"""regexp_extract_all(translate(replace(replace(replace(replace(regexp_replace(lower(strip_accents({c})), '[\x{{AD}}\x{{200B}}-\x{{200D}}\x{{2060}}\x{{FEFF}}\x{{300}}-\x{{36F}}]', '', 'g'), 'ß', 'ss'), 'æ', 'ae'), 'œ', 'oe'), 'þ', 'th'), 'łøđðħı', 'loddhi'), '[\p{{L}}\p{{N}}]+')"""

_PAIRS = f"""with i as (select item_id, {_WORDS.format(c="item_text")} as ws from eval_item),
  c as (select item_id, ws, len(ws) as n, least(len(ws), 13) as size from i where len(ws) > 0),
  ig as (select item_id, size, n - least(5, size) + 1 as ns, array_to_string(ws[k:k + size - 1], ' ') as gram, min(k) as pos
    from (select *, unnest(range(1, n - size + 2)) as k from c) group by all),
  d as (select doc_id, {_WORDS.format(c="text")} as ws from documents where text is not null),
  s as (select distinct size from c),
  dg as (select distinct doc_id, array_to_string(ws[k:k + size - 1], ' ') as gram
    from (select doc_id, ws, size, unnest(range(1, len(ws) - size + 2)) as k from d, s where len(ws) >= size)),
  pairs as (select doc_id, item_id, ns, size, pos, gram from dg join ig using (gram))
"""

SQL: dict[str, str] = {
    "p7_found": _PAIRS + "select distinct doc_id, item_id from pairs",
    "p7_leaks": _PAIRS + """, covered as (select doc_id, item_id, max(ns) as ns, count(distinct gram) as n_passages, count(distinct j) as hit
      from (select *, unnest(range(pos, pos + greatest(size - 4, 1))) as j from pairs) group by all)
    select doc_id, item_id, n_passages, round(least(hit / ns, 1), 6) as containment from covered""",
}
