"""The definitions of the queries in SQL: words as the kernel compares them, and runs of them."""

from __future__ import annotations

from .textkernel import LOOKALIKES

_FROM = "ς" + "".join(LOOKALIKES) + "".join(map(chr, (*range(0xFF10, 0xFF1A), *range(0xFF41, 0xFF5B))))
_TO = "σ" + "".join(LOOKALIKES.values()) + "".join(map(chr, (*range(0x30, 0x3A), *range(0x61, 0x7B))))
#: Ignorable characters, as a class of RE2.
UNSEEN = r"[\p{Cf}\p{Mn}\p{Me}]"


def words(text: str) -> str:
    """The list of words of a text, folded; ς counts as σ before look-alikes are put into one form."""
    low = f"translate(lower(regexp_replace(strip_accents(translate(lower({text}), '{_FROM}', '{_TO}')), '{UNSEEN}', '', 'g')), '{_FROM}', '{_TO}')"
    return rf"list_filter(string_split(regexp_replace({low}, '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' '), lambda w: w <> '')"


def runs(source: str, key: str, k: int) -> str:
    """A query of key and run for every run of k words of the lists w in a relation."""
    return f"select distinct {key}, array_to_string(w[i:i + {k - 1}], ' ') as run from (select {key}, w, unnest(range(1, greatest(len(w) - {k - 2}, 1))) as i from {source} where len(w) >= {k})"


P1_FOUND = f"""with t as (select record_id, split = 'train' as train, {words('text')} as w from records where record_id is not null and split is not null and text <> '' group by all),
r as ({runs('t', 'record_id, train', 5)}), n as (select record_id, train, count(*) as n from r group by all),
c as (select a.record_id as x, b.record_id as y, count(*) as k from r a join r b on a.run = b.run and a.train and not b.train and a.record_id <> b.record_id group by all)
select distinct least(x, y) as record_id_a, greatest(x, y) as record_id_b from c join n p on p.record_id = x and p.train join n q on q.record_id = y and not q.train where 2 * k >= least(p.n, q.n)"""

#: A word divided by a hyphen at a line end made whole.
_WHOLE = r"regexp_replace(text, '([\p{L}\p{N}])[-‐‑\xad][ \t]*\r?\n\s*([\p{L}\p{N}])', '\1\2', 'g')"
P7_FOUND = f"""with d as (select distinct doc_id, {words('text')} as w from documents where doc_id is not null and text <> ''
union select distinct doc_id, {words(_WHOLE)} as w from documents where doc_id is not null and text <> ''),
b as (select distinct item_id, {words('text')} as w from benchmark where item_id is not null and text <> ''),
x as ({runs('d', 'doc_id', 12)}), y as ({runs('b', 'item_id', 12)})
select distinct item_id, doc_id from x join y using (run)"""

P4_SEQUENCES = r"""with once as (select record_id, coalesce(any_value(labels_flat), any_value(flatten(list_filter(document_level_annotations, lambda g: g is not null)))) as l from records where record_id is not null group by record_id),
c as (select record_id, list_filter(list_transform(list_filter(l, lambda x: x is not null), lambda x: upper(regexp_replace(x, '^\s+|\s+$', '', 'g'))), lambda x: x <> '') as c from once where l is not null),
g as (select record_id, c[i] || ' ' || c[i + 1] as codes from (select record_id, c, unnest(range(1, greatest(len(c), 1))) as i from c))
select codes, count(*) as occurrences, count(distinct record_id) as records from g group by codes"""
