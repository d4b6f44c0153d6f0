"""The quality rules in DuckDB's SQL: long tables of histogram bins instead of vectors, one pair of steps for each round."""

from __future__ import annotations

from .quality_rules import ASCII_CLASSES, COMMON_WORDS, vocabulary


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def quality_sql(rounds: int = 3, least_chars: int = 200, least_words: int = 50, class_limit: tuple[float, float] = (0.08, 2.0), word_limit: tuple[float, float] = (0.3, 2.2), least_reference: int = 5) -> str:
    known = ", ".join(map(_quoted, vocabulary(COMMON_WORDS)))
    langs = ", ".join(map(_quoted, sorted(COMMON_WORDS)))
    ascii_ = " ".join(f"when code in ({', '.join(str(ord(c)) for c in chars)}) then '{name}'" for name, chars in ASCII_CLASSES.items())
    steps, kept = [], "select doc_id from good"
    for k in range(rounds):
        steps.append(f"""
        kept{k} as ({kept}),
        shares{k} as (
            select h.lang, h.kind, h.bin, round_even(1000000 * h.c / h.total, 0)::bigint as share, h.doc_id from hist h join kept{k} using (doc_id)),
        sums{k} as (
            select lang, kind, bin, sum(share) as share from shares{k} where lang <> 'other' group by all
            union all select 'other', kind, bin, sum(share) from shares{k} group by all),
        refs{k} as (select *, sum(share) over (partition by lang, kind) as whole from sums{k}),
        usable{k} as (select lang, kind, bin, share / whole as q from refs{k} where whole >= {least_reference} * 1000000 * 0.99),
        pairs{k} as (
            select h.doc_id, h.kind, c / total as p, coalesce(u.q, 0) as q from hist h
            join (select distinct lang, kind from usable{k}) l on l.lang = h.lang and l.kind = h.kind left join usable{k} u on u.lang = h.lang and u.kind = h.kind and u.bin = h.bin),
        distances{k} as (
            select doc_id, kind, sqrt(greatest(least((sum(p * log2(p / ((p + q) / 2))) + sum(case when q > 0 then q * log2(q / ((p + q) / 2)) else 0 end) + 1 - sum(q)) / 2, 1), 0)) as d
            from pairs{k} group by doc_id, kind),
        far{k} as (
            select distinct d.doc_id from distances{k} d join base b using (doc_id)
            where (kind = 'classes' and word_chars >= {least_chars} and d > {class_limit[0]} + {class_limit[1]} / sqrt(word_chars))
               or (kind = 'common' and n_words >= {least_words} and d > {word_limit[0]} + {word_limit[1]} / sqrt(n_words)))""")
        kept = f"select doc_id from good where doc_id not in (select doc_id from far{k})"
    return rf"""
        with docs as (select doc_id, case when lang in ({langs}) then lang else 'other' end as lang, coalesce(text, '') as text from documents),
        lists as (select doc_id, lang, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w from docs),
        words as (select doc_id, lang, unnest(w) as word, unnest(range(1, len(w) + 1)) as pos from lists),
        single as (select doc_id, count(*) as n_words, sum(length(word)) as word_chars from words group by doc_id),
        triples as (
            select doc_id, pos, word as a, lead(word, 1) over w as b, lead(word, 2) over w as c from words window w as (partition by doc_id order by pos)),
        again as (select doc_id, a, b, c from triples where c is not null group by all having count(*) > 1),
        covered as (
            select doc_id, count(*) as n from (select distinct t.doc_id, t.pos + k as pos from triples t join again g on t.doc_id = g.doc_id and t.a = g.a and t.b = g.b and t.c = g.c, range(0, 3) as r(k)) group by doc_id),
        lines as (select doc_id, unnest(string_split(text, chr(10))) as line from docs),
        dups as (select doc_id, count(*) - count(distinct line) as n from lines where regexp_matches(line, '[^\x20\x09-\x0D]') group by doc_id),
        base as (
            select d.doc_id, d.lang, coalesce(s.n_words, 0)::bigint as n_words, coalesce(s.word_chars, 0)::bigint as word_chars,
                   (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols, coalesce(u.n, 0)::bigint as n_dup_lines, coalesce(v.n, 0)::bigint as n_repeat_words
            from docs d left join single s using (doc_id) left join dups u using (doc_id) left join covered v using (doc_id)),
        good as (select doc_id from base where n_words >= {max(50, least_words)} and word_chars >= {least_chars} and 100 * n_repeat_words <= 50 * n_words),
        chars as (select doc_id, lang, unicode(unnest(string_split(text, ''))) as code from docs where text <> ''),
        classes as (
            select doc_id, lang, 'classes' as kind, case {ascii_} when code < 128 then 'control' when code < 576 then 'latin' when code < 2048 then 'letters' when code < 65536 then 'wide' else 'plane' end as bin from chars),
        bare as (select doc_id, lang, translate(word, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as w from words),
        trimmed as (select doc_id, lang, case when right(w, 1) in ('.', ',', ';', ':', '!', '?') then left(w, length(w) - 1) else w end as w from bare),
        common as (select doc_id, lang, 'common' as kind, case when w in ({known}) then w else '' end as bin from trimmed),
        counted as (select doc_id, lang, kind, bin, count(*) as c from (select * from classes union all select * from common) group by all),
        hist as (select *, sum(c) over (partition by doc_id, kind) as total from counted),
        {", ".join(steps)}
        select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
               not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and doc_id not in (select doc_id from far{rounds - 1}) as kept
        from base"""
