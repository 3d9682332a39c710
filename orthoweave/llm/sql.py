"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_ENTITIES = {"&nbsp;": " ", "&copy;": "©", "&middot;": "·", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "''", "&apos;": "''", "&amp;": "&"}


def _text(html: str) -> str:
    t = f"regexp_replace({html}, '(?is)<(script|style)[^>]*>.*?</(?:script|style)>', ' ', 'g')"
    t = f"regexp_replace({t}, '(?s)<!--.*?-->', ' ', 'g')"
    t = rf"regexp_replace({t}, '[\r\n\t]+', ' ', 'g')"
    t = f"regexp_replace({t}, '(?i)</(p|div|h[1-6]|li|ul|ol|tr|table|article|section|nav|footer|header|title|head)>|<br[^>]*>', chr(10), 'g')"
    t = f"regexp_replace({t}, '<[^>]*>', ' ', 'g')"
    for k, v in _ENTITIES.items():
        t = f"replace({t}, '{k.replace(chr(39), chr(39) * 2)}', '{v}')"
    t = f"regexp_replace({t}, ' +', ' ', 'g')"
    t = rf"regexp_replace({t}, ' ?\n[ \n]*', chr(10), 'g')"
    return rf"trim(regexp_replace({t}, '^\n|\n$', '', 'g'), ' ')"


def _urn(parts: str) -> str:
    h = f"sha256({parts})"
    return f"'<urn:uuid:' || concat_ws('-', substr({h}, 1, 8), substr({h}, 9, 4), substr({h}, 13, 4), substr({h}, 17, 4), substr({h}, 21, 12)) || '>'"


OP1 = rf"""
with p as (select page_id, url, coalesce(html, '') as html from pages),
r as (select page_id, url, html,
        {_urn("concat_ws('|', 'response', coalesce(page_id::varchar, ''), coalesce(url, ''), md5(html))")} as source_id,
        'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) || 'Content-Length: ' || strlen(html)::varchar as http
      from p),
d as (select *, 'sha256:' || sha256(html) as payload_digest, 'sha256:' || sha256(http || chr(13) || chr(10) || chr(13) || chr(10) || html) as source_digest from r),
b as (select page_id, url, source_id, payload_digest, source_digest, 'metadata' as type, 'application/warc-fields' as content_type,
        'title: ' || regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g') || chr(13) || chr(10) || 'source-content-type: text/html' || chr(13) || chr(10) ||
        'source-payload-digest: ' || payload_digest || chr(13) || chr(10) || 'source-header: ' || replace(http, chr(13) || chr(10), chr(13) || chr(10) || 'source-header: ') || chr(13) || chr(10) as block
      from d
      union all
      select page_id, url, source_id, payload_digest, source_digest, 'conversion', 'text/plain; charset=utf-8', {_text("html")} from d)
select page_id, {_urn("concat_ws('|', type, source_id)")} as record_id, type, url as target_uri, source_id as refers_to, content_type,
       payload_digest as source_payload_digest, source_digest as source_block_digest, block, 'sha256:' || sha256(block) as block_digest
from b
"""

OP3 = r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
win as (select doc_id, i, array_to_string(ws[i:i + 19], ' ') as win from (select doc_id, ws, unnest(range(1, len(ws) - 18)) as i from w where len(ws) >= 20)),
dup as (select doc_id, i from (select doc_id, i, row_number() over (partition by win order by doc_id, i) as n from win) where n > 1),
pos as (select doc_id, unnest(range(1, len(ws) + 1)) as p, unnest(ws) as word from w where len(ws) > 0),
gone as (select distinct doc_id, unnest(range(i, i + 20)) as p from dup),
kept as (select pos.doc_id, count(gone.p) as n_removed, string_agg(case when gone.p is null then word end, ' ' order by pos.p) as kept
         from pos left join gone on pos.doc_id = gone.doc_id and pos.p = gone.p group by pos.doc_id)
select w.doc_id, len(ws)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from w left join kept on w.doc_id = kept.doc_id
"""

_CUTS = {
    "symbols": ("n_symbols", "n_words", (0.05, 0.1, 0.2, 0.3, 0.5, 0.8)),
    "duplicate_lines": ("n_dup_lines", "n_lines", (0.1, 0.2, 0.3, 0.4, 0.5, 0.7)),
    "repeats": ("n_repeat_words", "n_words", (0.03, 0.06, 0.09, 0.12, 0.15, 0.18)),
    "capitals": ("n_capitals", "word_chars", (0.1, 0.2, 0.3, 0.4, 0.5, 0.7)),
    "exclamations": ("n_exclamations", "n_words", (0.05, 0.1, 0.2, 0.3, 0.5, 0.8)),
    "word_length": ("word_chars", "n_words", (7.0, 8.0, 9.0, 10.0, 12.0, 15.0)),
}
_RULE_ROWS = " union all ".join(f"select doc_id, lang, good, '{r}' as rule, {a}::double / greatest({b}, 1) as v from m2" for r, (a, b, _) in _CUTS.items())
_CUT_ROWS = ", ".join(f"('{r}', {c}::double)" for r, (_, _, cs) in _CUTS.items() for c in cs)
_REJECTS = " or ".join(f"(c.rule = '{r}' and {a}::double / greatest({b}, 1) > c.cutoff)" for r, (a, b, _) in _CUTS.items())

OP9 = rf"""
with t as (select doc_id, coalesce(lang, '') as lang, coalesce(text, '') as text from documents),
w as (select doc_id, lang, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as ws, [x for x in string_split(text, chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] as ls from t),
win as (select doc_id, i, array_to_string(ws[i:i + 4], ' ') as g from (select doc_id, ws, unnest(range(1, len(ws) - 3)) as i from w where len(ws) >= 5)),
rep as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) as n from win) where n > 1),
cov as (select doc_id, count(distinct p) as n from (select doc_id, unnest(range(i, i + 5)) as p from rep) group by doc_id),
m as (select w.doc_id, lang, len(ws)::bigint as n_words, len(ls)::bigint as n_lines, (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines,
        length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
        length(regexp_replace(text, '[^A-Z]', '', 'g'))::bigint as n_capitals,
        length(regexp_replace(text, '[^!]', '', 'g'))::bigint as n_exclamations,
        coalesce(cov.n, 0)::bigint as n_repeat_words
      from w left join cov on w.doc_id = cov.doc_id),
b as (select *, (n_words < 10 or 100 * n_repeat_words > 20 * n_words) as base_failed from m),
m2 as (select b.*, l.quality > 0 as good from b join (select doc_id, min(quality) as quality from labels where quality is not null group by doc_id) l on b.doc_id = l.doc_id where not base_failed),
v as ({_RULE_ROWS}),
cuts(rule, cutoff) as (values {_CUT_ROWS}),
tests as (select lang, v.rule, cutoff, count(*) filter (good) as n_good, count(*) filter (not good) as n_bad,
            count(*) filter (good and v.v > cutoff) as good_out, count(*) filter (not good and v.v > cutoff) as bad_out
          from v join cuts on v.rule = cuts.rule group by all),
risk as (select *, 0.05 / 6 as p, (select count(distinct lang) from tests) * 36 as n_tests from tests),
tail as (select r.*, case when good_out > n_good * p then 1.0 else
           (select sum(exp(lgamma(n_good + 1) - lgamma(i + 1) - lgamma(n_good - i + 1) + i * ln(p) + (n_good - i) * ln(1 - p))) from (select unnest(range(0, good_out + 1)) as i)) end as p_value from risk r),
ok as (select *, bad_out / greatest(n_bad, 1)::double - good_out / greatest(n_good, 1)::double as gain from tail where p_value <= 0.05 / n_tests),
c as (select lang, rule, cutoff from (select *, row_number() over (partition by lang, rule order by gain desc, cutoff desc) as n from ok where gain > 0) where n = 1)
select b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (not base_failed and not exists (select 1 from c where c.lang = b.lang and ({_REJECTS}))) as kept
from b
"""

ORACLES = {"op1_warc_derivatives": OP1, "op3_substring_dedup": OP3, "op9_quality_rules": OP9}
