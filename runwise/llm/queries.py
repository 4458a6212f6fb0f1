"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from runwise.session import scratch_path, written

from . import brown, decontaminate, fim, language, lines, mixing, neardup, quality, substrings, tokens, topk, urls, whitening
from .common import LOWER, PLAIN_WORD, SPACED_WORD, UPPER, id_crc, table


def op1_language_id(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    held_out = id_crc("doc_id") % 4 == 2
    model = language.fit(docs.filter(~held_out))
    return docs.select("doc_id", held_out.alias("held_out"), language.identify(docs, model).alias("l")).select("doc_id", "held_out", "l.*")


def op2_url_filters(spark: SparkSession, d: str) -> DataFrame:
    return urls.judge_urls(table(spark, d, "pages"))


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_token_output(spark: SparkSession, d: str) -> DataFrame:
    return token_output(spark, table(spark, d, "documents"))


def token_output(spark: SparkSession, docs: DataFrame, order: Sequence[Column] = ()) -> DataFrame:
    """Write the Arrow shards of ``docs``, by id or by ``order``, to the shared folder and read them back."""
    path = scratch_path(spark, "tokens")
    tokens.write_tokens(docs, f"{path}/shards", tokenizer_file(), order=order).write.parquet(f"{path}/index")
    index = spark.read.parquet(f"{path}/index")
    return tokens.read_documents(tokens.with_starts(index), f"{path}/shards")


def op4_suffix_dedup(spark: SparkSession, d: str) -> DataFrame:
    return substrings.cut_repeats(table(spark, d, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op5_mixing(spark: SparkSession, d: str) -> DataFrame:
    # the order by the weights' schedules is written, with its positions, and what is taken is read off it
    order = written(mixing.training_order(table(spark, d, "documents")), "training_order")
    of_row = order.groupBy("source", "part", "number").agg(
        *(F.max(c).alias(c) for c in ("doc_id", "size", "source_size", "target")), F.sum("words").alias("taken"))
    return of_row.select("doc_id", "size", "source_size", "target", "taken")


def op6_near_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, d, "documents")).select("doc_id", "class_id")


def op7_decontamination(spark: SparkSession, d: str) -> DataFrame:
    return decontaminate.contamination(table(spark, d, "documents"), table(spark, d, "benchmark")).select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op8_quality_rules(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "documents").select("doc_id", quality.line_quality("text").alias("q"))
    return q.select("doc_id", *(f"q.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")))


def op9_line_dedup(spark: SparkSession, d: str) -> DataFrame:
    return lines.line_counts(table(spark, d, "documents"))


def op10_lm_scoring(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    held_out = id_crc("doc_id") % 10 == 0
    return brown.fit_and_score(spark, docs, ~held_out).select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op11_fill_in_middle(spark: SparkSession, d: str) -> DataFrame:
    out = fim.fill_in_middle(table(spark, d, "documents"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                      F.sha2(fim.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


def op12_embedding_whitening(spark: SparkSession, d: str) -> DataFrame:
    out = whitening.whiten(table(spark, d, "embeddings"))
    return out.withColumn("deviation", F.col("deviation").cast("bigint"))


def op13_top_products(spark: SparkSession, d: str) -> DataFrame:
    return topk.top_products(table(spark, d, "embeddings"), F.col("vec_id") % 20 == 0)


QUERIES = {f.__name__: f for f in (op1_language_id, op2_url_filters, op3_token_output, op4_suffix_dedup, op5_mixing, op6_near_duplicates, op7_decontamination, op8_quality_rules, op9_line_dedup, op10_lm_scoring, op11_fill_in_middle, op12_embedding_whitening, op13_top_products)}

SQL = {
    "op2_url_filters": rf"""
        with p as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) end r from pages),
        h as (select page_id, coalesce(translate(regexp_extract(r, '^[^/?#]*'), '{UPPER}', '{LOWER}'), '') host,
            coalesce(regexp_extract(r, '^[^/?#]*([^?#]*)', 1), '') path from p),
        u as (select *, case
                when (host = 'example.com' or host like '%.example.com') and path like '/de/%' then 'example.com/de/'
                when (host = 'example.net' or host like '%.example.net') and path like '/en/%' then 'example.net/en/'
                when (host = 'org' or host like '%.org') and path like '/fr/%' then 'org/fr/'
                when (host = 'net' or host like '%.net') and path like '/%' then 'net/' end rule,
            string_split(path, '/') e from h),
        y as (select *, array_to_string(list_transform(e[2:], lambda s: regexp_replace(regexp_replace(
                s, '^[0-9]+(\.[A-Za-z0-9]+)?$', '<num>\1'), '^[0-9a-fA-F-]{{16,}}(\.[A-Za-z0-9]+)?$', '<id>\1')), '/') typed,
            case when rule in ('net/', 'example.com/de/') then 'block' when rule is not null then 'allow' end label from u),
        l as (select host, typed, count(*) n, count(*) filter (label = 'allow') good, count(*) filter (label = 'block') bad from y group by 1, 2),
        s as (select host, typed, n, i, s[i] seg, array_to_string(s[1 : i - 1], '/') pre, not regexp_matches(s[i], '^(<|\*|$)') lit
            from (select *, unnest(range(1, len(s) + 1)) i from (select *, string_split(typed, '/') s from l))),
        v as (select host, pre, i from s where lit group by 1, 2, 3 having count(distinct seg) > 20 and sum(n) < 5 * count(distinct seg)),
        o as (select s.host, s.typed, list(case when lit and v.host is not null then '*' else seg end order by s.i) parts
            from s left join v on s.host = v.host and s.pre = v.pre and s.i = v.i group by 1, 2),
        f as (select *, list_filter(parts, lambda x: not regexp_matches(x, '^(<|\*|$)'))[1] first from o),
        t as (select l.*, array_to_string(parts, '/') own, case when first is null then array_to_string(parts, '/') else array_to_string(list_concat(
            parts[1 : list_position(parts, first) - 1], ['*'], parts[list_position(parts, first) + 1 :]), '/') end pattern
            from l join f using (host, typed)),
        b as (select host, pattern, own, sum(good) good, sum(bad) bad from t group by 1, 2, 3),
        a as (select *, sum(good) over w ag, sum(good + bad) over w al from b window w as (partition by host, pattern)),
        k as (select *, case when al > 0 then (10 * (good * al + 4 * ag)) // (al * (good + bad + 4)) else -1 end g from a),
        j as (select host, own, pattern, ag, al, count(*) over w c, sum(good) over w sg, sum(good + bad) over w sl from k
            window w as (partition by host, pattern, g))
        select page_id, y.host, path, rule, coalesce(label, case when case when sl > 0 then 5 * (sg + 1) < sl + 2 else 5 * (ag + 1) < al + 2 end
                then 'block' else 'allow' end) verdict,
            case when c > 1 then j.pattern else j.own end "template"
        from y join t on y.host = t.host and y.typed = t.typed join j on j.host = t.host and j.own = t.own and j.pattern = t.pattern""",
    "op5_mixing": rf"""
        with r as (select doc_id, source, md5(concat_ws(':', '0', coalesce(cast(doc_id as varchar), ''))) o,
            coalesce(len(regexp_extract_all(text, '{SPACED_WORD}')), 0) size from documents),
        s as (select source, cast(sum(size) as bigint) source_size from r group by 1),
        p as (select *, row_number() over (order by source nulls last) - 1 place from s),
        q as (select *, (case place % 3 when 0 then 5 when 1 then 2 else 1 end)::double weight, 2.0::double * source_size cap from p),
        l as (select *, cap / weight full_at, 1.5::double * sum(source_size) over () total from q),
        m as (select *, (total - coalesce(sum(cap) over (order by full_at, source nulls last rows between unbounded preceding and 1 preceding), 0))
            / sum(weight) over (order by full_at, source nulls last rows between current row and unbounded following) lv from l),
        v as (select arg_min(lv, full_at) lv from m where lv <= full_at),
        t as (select source, source_size, least(cap, v.lv * weight) target from m, v),
        o as (select r.*, t.source_size, t.target, sum(size) over (partition by r.source order by o, doc_id, size
            rows between unbounded preceding and current row) - size at_ from r join t on r.source is not distinct from t.source)
        select doc_id, size, source_size, target, cast(
            greatest(0, least(size, round(target) - at_)) + greatest(0, least(size, round(target) - at_ - source_size)) as bigint) taken from o""",
    "op7_decontamination": rf"""
        with b as (select cast(item_id as varchar) item, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{PLAIN_WORD}') w from benchmark),
        bl as (select item, w, least(13, len(w)) n from b where len(w) > 0),
        bw as (select distinct item, n, array_to_string(w[i : i + n - 1], ' ') g from (select *, unnest(range(1, len(w) - n + 2)) i from bl)),
        d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{PLAIN_WORD}') w from documents),
        dl as (select doc_id, w, n from d, (select distinct n from bw) where len(w) >= n),
        h as (select doc_id, i, x.n, item from (select doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') g
            from (select *, unnest(range(1, len(w) - n + 2)) i from dl)) x join bw on x.n = bw.n and x.g = bw.g),
        c as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(i, i + n)) p from h) group by 1),
        e as (select doc_id, count(distinct item) n_items, array_to_string(list_sort(list(distinct item)), ',') items from h group by 1)
        select doc_id, cast(len(w) as bigint) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items,
            sha256(coalesce(items, '')) items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) contaminated
        from d left join c using (doc_id) left join e using (doc_id)""",
    "op8_quality_rules": rf"""
        with d as (select doc_id, coalesce(text, '') text from documents),
        w as (select doc_id, text, regexp_extract_all(text, '{SPACED_WORD}') w from d),
        g as (select doc_id, i, count(*) over (partition by doc_id, array_to_string(w[i : i + 7], ' ')) c
            from (select doc_id, w, unnest(range(1, len(w) - 6)) i from w where len(w) >= 8)),
        r as (select doc_id, count(distinct p) n_repeat_words from (select doc_id, unnest(range(i, i + 8)) p from g where c > 1) group by 1),
        a as (select doc_id, line, regexp_extract_all(line, '{SPACED_WORD}') w from (select doc_id, unnest(string_split(text, chr(10))) line from d)),
        f as (select doc_id, line, length(array_to_string(w, '')) chars,
            len(w) >= 10 and (len(list_distinct(w)) * 5 <= len(w) or not regexp_matches(line, '[.,;:!?…\x{{037E}}։՝՜՞،؛؟۔܀।॥෴ฯ๚๛།༎၊။፠።፣፤፥፦፧፨។៕៖᠂᠃᠅、。，．：；！？｡､]'))
            or 2 * len(regexp_extract_all(line, '[#*$%&|<>]')) > len(w) or 2 * len(regexp_extract_all(line, '!')) > len(w)
            or len(w) >= 3 and 3 * len(list_filter(w, lambda x: x in ('|', '»', '›', '•', '·', '>', '<', '/', '-', '–'))) >= len(w)
            or regexp_matches(line, '(?i)cookie (?:policy|settings)|all rights reserved|privacy policy|terms of (?:use|service)|enable javascript|subscribe to|click here|sign up for|share this') bad
            from a where len(w) > 0),
        l as (select doc_id, count(*) - count(distinct line) n_dup_lines, sum(chars) chars, sum(case when bad then chars else 0 end) lost from f group by 1),
        x as (select doc_id, len(w) n_words, length(array_to_string(w, '')) word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) n_symbols,
            coalesce(n_dup_lines, 0) n_dup_lines, coalesce(n_repeat_words, 0) n_repeat_words,
            len(w) < 20 or 100 * coalesce(n_repeat_words, 0) > 30 * len(w) base_failed, 100 * coalesce(lost, 0) <= 50 * coalesce(chars, 0) enough
            from w left join r using (doc_id) left join l using (doc_id))
        select doc_id, cast(n_words as bigint) n_words, cast(word_chars as bigint) word_chars, cast(n_symbols as bigint) n_symbols, n_dup_lines, n_repeat_words, base_failed,
            not base_failed and enough kept from x""",
    "op11_fill_in_middle": r"""
        with d as (select doc_id, coalesce(text, '') t, sha256(concat('7:', coalesce(cast(doc_id as varchar), ''))) h from documents),
        u as (select *, regexp_extract_all(t, '[^\n]*\n|[^\n]+') u, list_transform([1, 9, 17, 25], lambda i: cast('0x' || substr(h, i, 8) as bigint)) r from d),
        c as (select *, len(u) n, list_transform(r[1:2], lambda x: x % (len(u) + 1)) c,
            case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or r[3] % 100 >= 100 then 'plain'
                when r[4] % 100 < 50 then 'spm' else 'psm' end form from u),
        p as (select *, array_to_string(u[1 : list_min(c)], '') p, array_to_string(u[list_min(c) + 1 : list_max(c)], '') m,
            array_to_string(u[list_max(c) + 1 :], '') s from c)
        select doc_id, cast(n as bigint) n, form, case when form <> 'plain' then cast(length(p) as bigint) end prefix_chars,
            case when form <> 'plain' then cast(length(m) as bigint) end middle_chars,
            sha256(case form when 'plain' then t when 'psm' then concat('<P>', p, '<S>', s, '<M>', m) else concat('<S>', s, '<P>', p, '<M>', m) end) output_sha256,
            sha256(t) restored_sha256 from p""",
    "op13_top_products": r"""
        with e as (select vec_id, list_transform(embedding, lambda x: floor(64 * cast(x as double))) x from embeddings
            where len(embedding) = len(list_filter(embedding, lambda x: x is not null and isfinite(x)))),
        s as (select q.vec_id query_id, c.vec_id, cast(list_dot_product(q.x, c.x) as bigint) score
            from e q join e c on q.vec_id % 20 = 0 and q.vec_id <> c.vec_id),
        r as (select *, row_number() over (partition by query_id order by score desc, vec_id) rank from s)
        select query_id, cast(rank as integer) rank, vec_id, score from r where rank <= 20""",
}
