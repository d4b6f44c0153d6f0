"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import bpe_encode
from .common import written
from .exact_dedup import exact_dedup
from .license_scan import license_scan, license_sql
from .mixing import mix
from .quality_rules import quality_rules
from .quality_sql import quality_sql
from .simhash import simhash_components
from .substring_dedup import substring_dedup
from .token_counts import token_counts
from .tool_calls import link_tool_calls
from .warc import read_archives, write_archives


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_table(spark, sf_dir, "documents")).drop("class_distance", "word_distance")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(_table(spark, sf_dir, "documents"), texts=False).drop("kept_text")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = written(write_archives(_table(spark, sf_dir, "pages")), "archives")
    return read_archives(archives).drop("uri")


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_encode(_table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json"), carry=["doc_id"], digests=True)


#: Two tools; the properties come in the order in which errors are listed.
SCHEMAS = {
    "search": {
        "type": "object",
        "properties": {"query": {"type": "string", "minLength": 1, "maxLength": 200}, "limit": {"type": "integer", "minimum": 1, "maximum": 10}},
        "required": ["query", "limit"],
        "additionalProperties": False,
    },
    "translate": {
        "type": "object",
        "properties": {"text": {"type": "string", "minLength": 1, "maxLength": 400}, "target": {"type": "string", "enum": ["de", "en", "es", "fr"]}},
        "required": ["text", "target"],
        "additionalProperties": False,
    },
}


def tool_messages(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results from plain turns, which have none: a user turn is a call of one of two tools by its number, with
    arguments made of its text; the assistant turn after it is its result; a call waits for that two turns before."""
    name = lambda turn: F.concat(F.lit("call_"), turn.cast("string"))
    turn, text, size = F.col("turn"), F.col("text"), F.length(F.coalesce("text", F.lit("")))
    search = F.to_json(F.struct(text.alias("query"), (size % 12).alias("limit")), {"ignoreNullFields": "false"})
    target = F.element_at(F.array(*map(F.lit, ["de", "en", "es", "fr", "it"])), size % 5 + 1)
    translate = F.to_json(F.struct(text.alias("text"), target.alias("target")), {"ignoreNullFields": "false"})
    first = turn % 4 < 2
    calls = conversations.where("role = 'user'").select(
        "conv_id",
        name(turn).alias("call_id"),
        "turn",
        F.when(first, "search").otherwise("translate").alias("name"),
        F.when(first, search).otherwise(translate).alias("arguments"),
        F.when(turn >= 2, name(turn - 2)).alias("after"),
    )
    return calls, conversations.where("role = 'assistant'").select("conv_id", name(turn - 1).alias("call_id"), "turn", text.alias("content"))


def op5_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_tool_calls(*tool_messages(_table(spark, sf_dir, "conversations")), SCHEMAS)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup(docs, carry=["doc_id"])


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(_table(spark, sf_dir, "documents"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(_table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.tiktoken"), carry=["doc_id"])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_warc": op3_warc,
    "op4_bpe": op4_bpe,
    "op5_tool_calls": op5_tool_calls,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_simhash": op7_simhash,
    "op8_license_scan": op8_license_scan,
    "op9_mixing": op9_mixing,
    "op10_token_counts": op10_token_counts,
}

ORACLE_SQL: dict[str, str] = {
    "op6_exact_dedup": """
        with t as (
            select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as norm from documents)
        select doc_id, max(doc_id) over (partition by norm) as keep_id, count(*) over (partition by norm) as group_size,
               doc_id = max(doc_id) over (partition by norm) as kept, sha256(norm) as text_sha256
        from t""",
    "op9_mixing": r"""
        with docs as (
            select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size from documents),
        source_sizes as (select source, sum(size)::bigint as source_size from docs group by source),
        numbered as (select *, row_number() over (order by source nulls last) - 1 as place from source_sizes),
        weighted as (select *, (place % 3 + 1)::bigint as weight, (sum(source_size) over ())::bigint as total from numbered),
        levels as (
            select *, (total - coalesce(sum(3 * source_size) over by_ratio, 0)) / (sum(weight) over () - coalesce(sum(weight) over by_ratio, 0)) as level
            from weighted window by_ratio as (order by source_size / weight, place rows between unbounded preceding and 1 preceding)),
        level as (select level as l from levels where weight * level <= 3 * source_size order by source_size / weight, place limit 1),
        targets as (select source, place, source_size, total, least((3 * source_size)::double, weight * (select l from level))::double as target,
                           least(greatest(total // 1048576, 16), 4096) as block from levels),
        shares as (
            select *, coalesce(lag(high) over (order by place), 0) as low
            from (select *, round(sum(target) over (order by place) / greatest(total, 1) * 4294967296)::bigint as high from targets)),
        slots as (
            select (slot * 2654435769) % 4294967296 as point
            from range(0, (select (max(total) + max(block) - 1) // max(block) from targets)) as t(slot)),
        drawn as (select place, count(*) as n from slots join shares on point >= low and point < high group by place),
        counts as (
            select s.place, s.source, s.source_size, s.target, s.block, (source_size + block - 1) // block as blocks,
                   least(coalesce(n, 0), 3 * ((source_size + block - 1) // block)) as n
            from shares s left join drawn d on d.place = s.place),
        placed as (
            select d.doc_id, d.size, c.*, coalesce(sum(d.size) over (partition by c.place order by md5('0:' || coalesce(d.doc_id::varchar, '')), d.doc_id, d.size
                                                   rows between unbounded preceding and 1 preceding), 0) as start
            from docs d join counts c on d.source is not distinct from c.source)
        select doc_id, size, source_size, target,
               case when size = 0 then 0 else (n // blocks) * size + greatest(0, least(start + size, (n % blocks) * block) - start) end::bigint as taken
        from placed""",
    "op3_warc": """
        with t as (select page_id, coalesce(html, '') as html, min(page_id) over (partition by coalesce(html, '')) as first from pages),
        b as (select *, array_to_string(list_transform(string_split(sha1(html), ''),
                   lambda c: substr('0000000100100011010001010110011110001001101010111100110111101111', (instr('0123456789abcdef', c) - 1) * 4 + 1, 4)), '') as bits from t)
        select page_id, octet_length(encode(html))::bigint as payload_bytes,
               array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   (1 + 16 * substr(bits, 5 * i + 1, 1)::int + 8 * substr(bits, 5 * i + 2, 1)::int + 4 * substr(bits, 5 * i + 3, 1)::int
                    + 2 * substr(bits, 5 * i + 4, 1)::int + substr(bits, 5 * i + 5, 1)::int)::bigint, 1)), '') as payload_digest,
               case when page_id = first then 'response' else 'revisit' end as record_type,
               case when page_id <> first then first end as refers_to
        from b""",
    "op2_substring_dedup": r"""
        with docs as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
        places as (select doc_id, words, unnest(range(1, len(words) - 48)) as pos from docs where len(words) >= 50),
        windows as (select doc_id, pos, md5(array_to_string(list_slice(words, pos, pos + 49), ' ')) as h from places),
        firsts as (select h, min(doc_id) as first from windows group by h),
        hits as (select doc_id, pos from windows join firsts using (h) where first < doc_id),
        gone as (select distinct doc_id, pos + k as pos from hits, range(0, 50) as r(k)),
        single as (select doc_id, unnest(range(1, len(words) + 1)) as pos, unnest(words) as word from docs),
        kept as (
            select s.doc_id, string_agg(word, ' ' order by s.pos) as text, count(*) as n
            from single s left join gone g on s.doc_id = g.doc_id and s.pos = g.pos where g.pos is null group by s.doc_id)
        select d.doc_id, len(words)::bigint as n_words, (len(words) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(k.text, '')) as kept_sha256
        from docs d left join kept k on d.doc_id = k.doc_id""",
    "op8_license_scan": license_sql(),
    "op5_tool_calls": """
        with calls as (
            select conv_id, turn, 'call_' || turn as call_id, coalesce(text, '') as text, length(coalesce(text, '')) as n, turn % 4 < 2 as search,
                   case when turn >= 2 then 'call_' || (turn - 2) end as wanted
            from conversations where role = 'user'),
        results as (select conv_id, 'call_' || (turn - 1) as call_id, text as content from conversations where role = 'assistant'),
        linked as (
            select c.*, r.content, case when r.call_id is null then 0 else 1 end as n_results, b.call_id as after_id, c.wanted is not null and b.call_id is null as after_missing
            from calls c left join results r on c.conv_id = r.conv_id and c.call_id = r.call_id
            left join calls b on c.conv_id = b.conv_id and c.wanted = b.call_id),
        islands as (select *, turn // 2 - row_number() over (partition by conv_id, turn % 2 order by turn) as island from linked),
        deep as (select *, row_number() over (partition by conv_id, turn % 2, island order by turn) - 1 as depth from islands),
        checked as (
            select *, row_number() over (partition by conv_id order by depth, turn, call_id) as position,
                   case when search then concat_ws('; ', case when n < 1 then 'minLength query' end, case when n > 200 then 'maxLength query' end,
                                                   case when n % 12 < 1 then 'minimum limit' end, case when n % 12 > 10 then 'maximum limit' end)
                        else concat_ws('; ', case when n < 1 then 'minLength text' end, case when n > 400 then 'maxLength text' end,
                                       case when n % 5 = 4 then 'enum target' end) end as errors
            from deep)
        select conv_id, call_id, depth::bigint as depth, position::bigint as position, n_results::bigint as n_results, false as duplicate, after_missing, errors = '' as valid, errors,
               '{"after":' || coalesce('"' || wanted || '"', 'null') || ',"arguments":'
               || case when search then '{"limit":' || (n % 12) || ',"query":' || to_json(text)::varchar || '}'
                       else '{"target":"' || (['de', 'en', 'es', 'fr', 'it'])[n % 5 + 1] || '","text":' || to_json(text)::varchar || '}' end
               || ',"id":"' || call_id || '","name":"' || case when search then 'search' else 'translate' end
               || '","result":' || coalesce(to_json(content)::varchar, 'null') || '}' as json
        from checked""",
    "op1_quality_rules": quality_sql(),
}
