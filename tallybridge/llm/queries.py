"""The registered queries of this subpackage: thin, over whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybridge.operators.stored import Workspace

from . import (
    exact_dedup,
    language_id,
    line_cleaning,
    minhash_dedup,
    packing,
    prefix_trie,
    secrets,
    token_counts,
    toxicity,
    transducer,
    url_filter,
    vector_dedup,
    whitening,
)

TOKENIZER = "byte_bpe_50k.json"
TOKEN_LIMIT = 1024
#: Conversations are rebuilt with up to three first turns of the first one of their twenty.
FAMILY, MOST_BORROWED = 20, 3
URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents")
    model = language_id.train(docs.where(~language_id.held_out(docs)))
    found = language_id.identify(docs, model, keep=["doc_id"])
    return found.select("doc_id", language_id.held_out(found).alias("held_out"), "lang_pred", "score")


def op2_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return token_counts.count_tokens(
        _table(spark, sf, "documents"), TOKENIZER, TOKEN_LIMIT, keep=["doc_id"]
    )


def op3_embedding_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return vector_dedup.near_duplicates(_table(spark, sf, "embeddings"))


def op4_secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents")
    ratios = secrets.train(secrets.samples_from(docs))
    found = secrets.scan(docs, ratios, keep=["doc_id"])
    base = [kind for kind, *_ in secrets.BASE]
    return found.select(
        "doc_id",
        *[F.expr(f"size(filter(spans, x -> x.kind = {i}))").cast("long").alias(f"n_{kind}")
          for i, kind in enumerate(base)],
        F.sha2(secrets.rendered(F.col("spans"), base), 256).alias("base_sha256"),
        secrets.rendered(F.col("spans")).alias("spans"),
    )


def op5_minhash_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return minhash_dedup.near_duplicates(_table(spark, sf, "documents"))


def op6_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(_table(spark, sf, "documents"), TOKENIZER, packing.WINDOW)


def op7_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs, labels = _table(spark, sf, "documents"), _table(spark, sf, "labels")
    model = toxicity.train(docs, labels.where(~toxicity.held_out(labels)))
    found = toxicity.score(docs, model, keep=["doc_id"])
    return found.select("doc_id", toxicity.held_out(found).alias("held_out"), "score", "predicted")


def op8_bpe_transducer(spark: SparkSession, sf: str) -> DataFrame:
    coded = transducer.encode(_table(spark, sf, "documents"), TOKENIZER, keep=["doc_id"])
    return transducer.decode(coded, TOKENIZER).select(
        "doc_id",
        F.expr("octet_length(ids) div 4").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )


def op9_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    return url_filter.judge_urls(_table(spark, sf, "pages"), URL_RULES, keep=["page_id"])


def op10_line_cleaning(spark: SparkSession, sf: str) -> DataFrame:
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return line_cleaning.clean(_table(spark, sf, "documents"), keep=["doc_id"]).select(
        "doc_id", *counts, "base_failed", "kept"
    )


def op11_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents")
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    found = exact_dedup.exact_duplicates(
        docs.select("doc_id", "text", digest.alias("text_sha256")), keep=["doc_id", "text_sha256"]
    )
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op12_prefix_trie(spark: SparkSession, sf: str) -> DataFrame:
    given = prefix_trie.paths(_table(spark, sf, "conversations"))
    workspace = Workspace(spark)
    rebuilt = prefix_trie.with_borrowed_beginnings(workspace.store(given), FAMILY, MOST_BORROWED)
    return prefix_trie.nodes_with_ends(workspace.store(rebuilt)).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
    )


def op13_embedding_whitening(spark: SparkSession, sf: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf, "embeddings"), keep=["vec_id"])


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_token_counts": op2_token_counts,
    "op3_embedding_dedup": op3_embedding_dedup,
    "op4_secret_scan": op4_secret_scan,
    "op5_minhash_dedup": op5_minhash_dedup,
    "op6_packing": op6_packing,
    "op7_toxicity": op7_toxicity,
    "op8_bpe_transducer": op8_bpe_transducer,
    "op9_url_filter": op9_url_filter,
    "op10_line_cleaning": op10_line_cleaning,
    "op11_exact_dedup": op11_exact_dedup,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_embedding_whitening": op13_embedding_whitening,
}

_UPPER, _LOWER = url_filter.UPPER, url_filter.LOWER
_WHITE = r"[\x20\x09-\x0D]"
_WORDS = r"[^\x20\x09-\x0D]+"


def _components_sql(nodes: str, links: str) -> str:
    """``reach``: the least id reachable from each node of a symmetric relation (a, b)."""
    return f"""
        seen(id, other) as (
            select id, id from {nodes} union select s.id, l.b from seen s join {links} l on l.a = s.other
        ),
        reach as (select id, min(other) as component_id from seen group by id)"""


ORACLE_SQL = {
    "op3_embedding_dedup": f"""
        with recursive given as (
            select vec_id as id, label, embedding::double[] as v from embeddings
        ),
        usable as (
            select * from given
            where label is not null and v is not null
              and len([x for x in v if x is null or not isfinite(x)]) = 0
              and len([x for x in v if x <> 0]) > 0
        ),
        links as (
            select a.id as a, b.id as b from usable a join usable b
            on a.label = b.label and len(a.v) = len(b.v) and a.id <> b.id
            where list_cosine_similarity(a.v, b.v) >= {vector_dedup.COSINE}
        ),
        {_components_sql("given", "links")}
        select id as vec_id, (select count(*) from links where a = reach.id) as n_links, component_id,
               id = component_id as kept
        from reach""",
    "op5_minhash_dedup": f"""
        with recursive given as (
            select doc_id as id, regexp_extract_all(
                translate(coalesce(text, ''), '{url_filter.UPPER}', '{url_filter.LOWER}'), '{_WORDS}') as w
            from documents
        ),
        shingles as (
            select distinct id, case when len(w) < 5 then array_to_string(w, ' ')
                                     else array_to_string(w[i:i + 4], ' ') end as s
            from given, unnest(range(1, greatest(len(w) - 3, 2))) r(i) where len(w) > 0
        ),
        sizes as (select id, count(*) as n from shingles group by id),
        links as (
            select x.id as a, y.id as b
            from shingles x join shingles y on x.s = y.s and x.id <> y.id
                 join sizes p on p.id = x.id join sizes q on q.id = y.id
            group by x.id, y.id, p.n, q.n
            having 100 * count(*) >= {minhash_dedup.PERCENT} * (p.n + q.n - count(*))
        ),
        {_components_sql("given", "links")}
        select reach.id as doc_id, coalesce(n, 0) as n_shingles, component_id, reach.id = component_id as kept
        from reach left join sizes on sizes.id = reach.id""",
    "op10_line_cleaning": f"""
        with given as (
            select doc_id, coalesce(text, '') as text,
                   regexp_extract_all(coalesce(text, ''), '{_WORDS}') as w,
                   [x for x in string_split(coalesce(text, ''), chr(10)) if regexp_matches(x, '{_WORDS}')] as lines
            from documents
        ),
        windows as (
            select doc_id, i, array_to_string(w[i:i + {line_cleaning.WINDOW - 1}], ' ') as s
            from given, unnest(range(1, len(w) - {line_cleaning.WINDOW - 2})) r(i)
            where len(w) >= {line_cleaning.WINDOW}
        ),
        repeated as (
            select doc_id, i from (select *, count(*) over (partition by doc_id, s) as c from windows) where c > 1
        ),
        covered as (
            select doc_id, sum(least({line_cleaning.WINDOW}, coalesce(following - i, {line_cleaning.WINDOW})))::bigint as n
            from (select *, lead(i) over (partition by doc_id order by i) as following from repeated)
            group by doc_id
        ),
        first_lines as (
            select doc_id, line, regexp_extract_all(line, '{_WORDS}') as w,
                   length(regexp_replace(line, '{_WHITE}', '', 'g')) as characters,
                   length(regexp_replace(line, '[^{line_cleaning.SEPARATORS}]', '', 'g')) as bars,
                   length(regexp_replace(line, '[^{line_cleaning.SYMBOLS}]', '', 'g')) as signs
            from (select doc_id, unnest(list_distinct(lines)) as line from given)
        ),
        remaining as (
            select doc_id, sum(characters) as n from first_lines
            where not (signs > {line_cleaning.SIGN_SHARE} * characters
                       or regexp_matches(lower(line), '{"|".join(line_cleaning.BOILERPLATE)}')
                       or (bars >= {line_cleaning.NAVIGATION} and bars >= {line_cleaning.NAVIGATION_SHARE} * len(w))
                       or len([i for i in range(2, len(w) + 1) if w[i] = w[i - 1]])
                          > {line_cleaning.STUTTER_SHARE} * len(w))
            group by doc_id
        ),
        counts as (
            select g.doc_id, len(w)::bigint as n_words,
                   length(regexp_replace(text, '{_WHITE}', '', 'g'))::bigint as word_chars,
                   length(regexp_replace(text, '[^{line_cleaning.SYMBOLS}]', '', 'g'))::bigint as n_symbols,
                   (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
                   coalesce(c.n, 0) as n_repeat_words, coalesce(r.n, 0) as characters_left
            from given g left join covered c on c.doc_id = g.doc_id left join remaining r on r.doc_id = g.doc_id
        )
        select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
               n_words < {line_cleaning.LEAST_WORDS}
                   or 100 * n_repeat_words > {line_cleaning.MOST_REPEATED} * n_words as base_failed,
               not (n_words < {line_cleaning.LEAST_WORDS}
                    or 100 * n_repeat_words > {line_cleaning.MOST_REPEATED} * n_words)
                   and 100 * characters_left >= {line_cleaning.LEAST_LEFT} * word_chars as kept
        from counts""",
    "op11_exact_dedup": """
        select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size,
               doc_id = max(doc_id) over same as kept, sha256(coalesce(text, '')) as text_sha256
        from documents window same as (partition by coalesce(text, ''))""",
    "op12_prefix_trie": f"""
        with turns as (
            select conv_id, list(struct_pack(h := h, words := words) order by turn nulls first, h) as t
            from (select conv_id, turn,
                         sha256(length(coalesce(role, ''))::varchar || ':' || coalesce(role, '') || coalesce(text, '')) as h,
                         len(regexp_extract_all(coalesce(text, ''), '{_WORDS}')) as words
                  from conversations where conv_id is not null)
            group by conv_id
        ),
        -- CRC-32 of the id in decimal, bit by bit
        lent as (
            select *, xor(list_reduce(
                list_prepend(4294967295::bigint, [ascii(x)::bigint for x in string_split(conv_id::varchar, '')]),
                lambda crc, c: list_reduce(
                    list_prepend(xor(crc, c), [0::bigint, 0, 0, 0, 0, 0, 0, 0]),
                    lambda v, z: xor(v >> 1, (v & 1) * 3988292384))), 4294967295) % {MOST_BORROWED + 1} as h
            from turns
        ),
        rebuilt as (
            select c.conv_id, coalesce(d.t[:c.h], []) || c.t[c.h + 1:] as t
            from lent c left join turns d on d.conv_id = c.conv_id - c.conv_id % {FAMILY}
        ),
        prefixes as (
            select conv_id, d, len(t) = d as ends, case when d > 0 then t[d].words else 0 end as words,
                   [sha256(array_to_string([x.h for x in t[:i]], '')) for i in range(0, d + 1)] as path
            from rebuilt, unnest(range(len(t) + 1)) r(d)
        ),
        nodes as (
            select path[-1] as k, any_value(path) as path, d, any_value(words) as words, min(conv_id) as conv_id,
                   count(*) as n, sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (ends), '')) as e,
                   count(*) filter (not ends) = 0 as leaf
            from prefixes group by path[-1], d
        ),
        below as (
            select k, sum(leaf::int) as leaves, sum((n - 1) * words) as saved, count(*) filter (d = place + 1) as children
            from (select unnest(path) as k, unnest(range(d + 1)) as place, leaf, n, words, d from nodes) group by k
        )
        select x.conv_id, x.d as depth, p.conv_id as parent_conv_id, x.n as n_convs, children as n_children,
               leaves::bigint as n_leaves, saved::bigint as saved_tokens, x.e as ends_sha256
        from nodes x join below b on b.k = x.k left join nodes p on p.k = x.path[-2]""",
    "op9_url_filter": f"""
        with rules(verdict, rule_host, rule_path) as (
            values {", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in URL_RULES)}
        ), rest as (
            select page_id, case when strpos(url, '://') > 0
                                 then substr(url, strpos(url, '://') + 3) end as r from pages
        ), parsed as (
            select page_id,
                   coalesce(translate(regexp_extract(r, '^[^/?#]*'), '{_UPPER}', '{_LOWER}'), '') as host,
                   coalesce(regexp_extract(r, '^[^/?#]*([^?#]*)', 1), '') as path
            from rest
        ), fits as (
            select p.*, rule_host || rule_path as rule, verdict,
                   row_number() over (partition by page_id order by len(rule_host) desc nulls last,
                                      len(rule_path) desc) as place
            from parsed p left join rules
                 on (host = rule_host or ends_with(host, '.' || rule_host))
                 and starts_with(path, rule_path)
        )
        select page_id, host, path, rule,
               case when rule is not null then verdict when host = '' then 'block' else 'allow' end as verdict
        from fits where place = 1""",
}
