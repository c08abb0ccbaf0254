"""Queries by name, with the SQL that must give the same rows.

Every query reads its whole tables and whole texts: ``documents`` itself, or for
what needs a lexer or parser source files that hold the texts as identifiers.
Where SQL is missing, the operator draws at random inside a parsed file or
trains a tokenizer, and tests hold it against its properties.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions.batches import bounded_batches
from codeloom.functions.durable import shared_dir
from codeloom.functions.text import INVALID, SPACE, VALID, lines, uniform
from codeloom.operators import fim, header, predict, quality, sampling, tokens
from codeloom.plans import corpus, pipelines
from codeloom.plans.corpus import FULL, code_corpus, fim_rows, has
from codeloom.shipping import ship
from codeloom.sources import io

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(bounded_batches(ship(spark)), sf_dir)

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql
        return run

    return add


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts, and after them the source files, whose doc_id is negative."""
    return _docs(spark, sf_dir).select("doc_id", "text").union(code_corpus(spark, sf_dir).selectExpr("-1 - doc_id", "content"))


_ALL = f"select doc_id, text from documents union all select -1 - doc_id, content from ({corpus.SQL})"
_BLANKS = SPACE[1:-1]
_SIZES = f"list_transform(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^{_BLANKS}]')), lambda x: length(x))"
_BAD = f"length(regexp_replace(text, '{VALID}', '', 'g'))"
_STATS = f"""select doc_id, text, len(s)::int as n_lines, coalesce(list_max(s), 0)::int as max_len, coalesce(list_sum(s), 0)::int as sum_len
from (select doc_id, text, {_SIZES} as s from documents)"""


def _u(tag: str, key: str, seed: int = 42) -> str:
    return f"(('0x' || substr(md5('{seed}:{tag}:' || {key}), 1, 8))::bigint / 4294967296.0::double)"


# quality predicates


@_query(f"select doc_id, n_lines, max_len, sum_len, (n_lines > 0 and max_len <= 1000 and sum_len <= 100 * n_lines) as ok from ({_STATS})")
def line_stats(spark, sf_dir):
    """Line-length rule and its statistics."""
    s = _docs(spark, sf_dir).select("doc_id", quality.line_statistics(F.col("text")).alias("s"))
    return s.select("doc_id", "s.*", quality.length_ok(F.col("s")).alias("ok"))


@_query(f"select doc_id, {_BAD}::int as n_bad, length(text)::int as n, length(text) > 0 and (length(text) - {_BAD}) / length(text) > 0.9 as ok90, length(text) > 0 and (length(text) - {_BAD}) / length(text) > 0.99 as ok99 from documents")
def char_ratio(spark, sf_dir):
    """Share of valid characters at both thresholds."""
    t = F.col("text")
    return _docs(spark, sf_dir).select(
        "doc_id", quality.invalid_count(t).alias("n_bad"), F.length(t).alias("n"), quality.characters_ok(t).alias("ok90"), quality.characters_ok(t, 0.99).alias("ok99")
    )


@_query(f"""select doc_id, n_lines, max_len, sum_len, {_BAD}::int as n_invalid, (n_lines > 0 and max_len <= 1000 and sum_len <= 100 * n_lines) as pass_length,
length(text) > 0 and (length(text) - {_BAD}) / length(text) > 0.99 as pass_chars, length(text) >= 500 as pass_size from ({_STATS})""")
def quality_annotate(spark, sf_dir):
    """All built-in verdicts of every document."""
    return quality.annotate(_docs(spark, sf_dir).select("doc_id", "text")).drop("text")


@_query(f"select doc_id, regexp_replace(text, '{INVALID}', '<UNK>', 'g') as text from documents")
def unk_replace(spark, sf_dir):
    """Invalid characters as ``<UNK>``."""
    return _docs(spark, sf_dir).select("doc_id", quality.mark_invalid(F.col("text")).alias("text"))


_TODO = f"(not {has('header_only')} and ({has('short')} or not {has('todo')}))"
_PARSES = f"({has('header_only')} or {has('short')} or not {has('syntax')})"


@_query(f"select doc_id, {_TODO} as todo_ok, {_PARSES} as syntax_ok, {_PARSES} and ({has('header_only')} or {has('short')} or not {has('empty_function')}) as functions_ok from documents")
def lexical_check(spark, sf_dir):
    """Verdicts of lexer and parser."""
    return code_corpus(spark, sf_dir).select("doc_id", quality.lexical("content").alias("q")).select("doc_id", "q.*")


# headers and blanks


@_query(rf"""select doc_id, (i - 1)::int as line_no, case when regexp_matches(x, '^#\s*!.*python') then 'shebang' when regexp_matches(x, '^.*(coding=|-\*-\s*coding:)') then 'coding'
when regexp_matches(x, '(?is)^.*{header.LICENSE}') then 'copyright' when regexp_matches(x, '^#\s*pylint') then 'pylint' else '' end as kind
from (select doc_id, i, ls[i] as x from (select doc_id, string_split(text, chr(10)) as ls from ({_ALL})), unnest(range(1, len(ls) + 1)) as u(i))""")
def header_class(spark, sf_dir):
    """Kind of every line as a comment, in texts and source files."""
    rows = _all(spark, sf_dir).select("doc_id", F.posexplode(lines(F.col("text"))).alias("line_no", "x"))
    return rows.select("doc_id", "line_no", header.comment_kind(F.col("x")).alias("kind"))


@_query(f"select doc_id, {corpus.STRIPPED} as text from {corpus.SOURCE} where not {has('header_only')}")
def header_strip(spark, sf_dir):
    """Files without header boilerplate."""
    return code_corpus(spark, sf_dir).select("doc_id", header.header_stripped("content").alias("text")).where("text is not null")


_RULES = f"""select doc_id, len(s) > 0 and list_max(s) <= 1000 and list_sum(s) <= 100 * len(s) and (length(text) - {_BAD}) / length(text) > 0.99 as ok
from (select doc_id, text, {_SIZES} as s from (select doc_id, content as text from ({corpus.SQL})))"""


@_query(f"""select doc_id, concat('', doc_id) as blob_id, {corpus.STRIPPED} as text from {corpus.SOURCE} join ({_RULES}) using (doc_id)
where ok and {FULL} and not {has('todo')} and not {has('syntax')}""")
def clean_pipeline(spark, sf_dir):
    """The whole cleaning chain."""
    return pipelines.clean(code_corpus(spark, sf_dir).withColumnRenamed("content", "text"))


def _marked(text: str) -> str:
    bare = f"regexp_replace(x, '^{SPACE}+', '')"
    return f"array_to_string(list_transform(string_split({text}, chr(10)), lambda x: case when {bare} = '' then '' when starts_with({bare}, '#') then x else replace(x, '    ', '<4BLANK>') end), chr(10))"


@_query(f"select doc_id, {_marked('text')} as text from ({_ALL})")
def blank_convert(spark, sf_dir):
    """Runs of four spaces as tokens, in texts and source files."""
    return _all(spark, sf_dir).select("doc_id", header.mark_blanks(F.col("text")).alias("text"))


@_query(f"select doc_id, text from ({_ALL})")
def blank_reset(spark, sf_dir):
    """Tokens for runs of spaces turned back: the round trip is the text itself."""
    return _all(spark, sf_dir).select("doc_id", header.unmark_blanks(header.mark_blanks(F.col("text"))).alias("text"))


# tokens and windows

_WINDOW = 512


@_query(f"""select doc_id, (i // {_WINDOW})::int as w, substr(text, greatest(least(i, length(text) - {_WINDOW}), 0)::int + 1, {_WINDOW}) as chunk
from documents, unnest(range(0, length(text), {_WINDOW})) as u(i) where length(text) > 0""")
def segment_windows(spark, sf_dir):
    """Windows with characters as tokens."""
    rows = _docs(spark, sf_dir).select("doc_id", F.filter(F.split("text", ""), lambda c: c != "").alias("t"))
    return tokens.segment(rows, "t", _WINDOW).select("doc_id", "w", F.array_join("window", "").alias("chunk"))


_BLOCK = 200
_TOKEN_LINES = f"select doc_id, i - 1 as g, length(ls[i]) + 1 as n_tokens from (select doc_id, string_split(text, chr(10)) as ls from ({_ALL})), unnest(range(1, len(ls) + 1)) as u(i)"


@_query(f"""select doc_id, g::int as g, n_tokens::int as n_tokens, ((e - n_tokens) // {_BLOCK})::int as first_block, ((e - 1) // {_BLOCK})::int as last_block, (e - n_tokens) // {_BLOCK} <> (e - 1) // {_BLOCK} as is_split
from (select *, sum(n_tokens) over (partition by doc_id order by g)::bigint as e from ({_TOKEN_LINES}) where n_tokens <= {_BLOCK})""")
def block_pack(spark, sf_dir):
    """Blocks of each line, characters as tokens."""
    rows = _all(spark, sf_dir).select("doc_id", F.posexplode(lines(F.col("text"))).alias("g", "x"))
    return fim.block_spans(rows.select("doc_id", "g", (F.length("x") + 1).alias("n_tokens")), _BLOCK)


_PATTERN = tokens.PRETOKEN


@_query(f"select sum(len(regexp_extract_all(text, '{_PATTERN}')))::bigint as n_tokens from documents")
def token_total(spark, sf_dir):
    """All tokens."""
    return tokens.token_total(_docs(spark, sf_dir).select(F.regexp_extract_all("text", F.lit(_PATTERN), F.lit(0)).alias("t")), "t")


@_query(f"select source, count(*) as n_samples, sum(len(regexp_extract_all(text, '{_PATTERN}')))::bigint as n_tokens from documents group by rollup (source)")
def token_per_source(spark, sf_dir):
    """Samples and tokens of each source and of all."""
    return tokens.tokens_by(_docs(spark, sf_dir), "source", F.size(F.regexp_extract_all("text", F.lit(_PATTERN), F.lit(0))))


@_query(f"select count(*) as n_tokens, count(*) filter (where regexp_matches(token, '{tokens.PLAIN}')) as n_plain from (select distinct unnest(string_split(text, ' ')) as token from documents)")
def vocab_audit(spark, sf_dir):
    """Distinct words, and those of letters and signs alone."""
    words = _docs(spark, sf_dir).select(F.explode(F.split("text", " ", -1)).alias("token")).distinct()
    plain = F.col("token").rlike(tokens.PLAIN)
    return words.agg(F.count(F.lit(1)).alias("n_tokens"), F.count_if(plain).alias("n_plain"))


@_query(f"select word, count(*) as freq from (select unnest(regexp_extract_all(text, '{_PATTERN}')) as word from documents) group by word")
def bpe_pretoken_counts(spark, sf_dir):
    """Pre-tokens and their counts."""
    return tokens.pretoken_counts(_docs(spark, sf_dir))


@_query("select doc_id, strlen(text) + 1 as n_tokens, text from documents")
def tokenize_only(spark, sf_dir):
    """Ids with random cuts and the end token, as many as bytes and one, and the text they stand for."""
    ids = tokens.encode(_docs(spark, sf_dir), tokens.ByteTokenizer())
    out = ids.select("doc_id", F.size("input_ids").cast("long").alias("n_tokens"), F.size("attention_mask").alias("m"), F.slice("input_ids", F.lit(1), F.size("input_ids") - 1).alias("ids"))
    return tokens.decode(out.where("m = n_tokens"), tokens.ByteTokenizer(), "ids").select("doc_id", "n_tokens", "text")


@_query("select doc_id, text from documents")
def bpe_round_trip(spark, sf_dir):
    """A tokenizer trained on all texts, saved and loaded; every text encoded with random cuts and decoded."""
    trained = tokens.train_bpe(_docs(spark, sf_dir), size=600)
    with tempfile.TemporaryDirectory() as folder:
        tokens.save_tokenizer(trained, folder)
        loaded = tokens.load_tokenizer(f"{folder}/tokenizer.json")
    ids = tokens.encode(_docs(spark, sf_dir), loaded, eos=False)
    return tokens.decode(ids, loaded).select("doc_id", "text")


@_query()
def bpe_token_counts(spark, sf_dir):
    """Tokens of each text under a tokenizer trained on all of them."""
    return tokens.token_counts(_docs(spark, sf_dir), tokens.train_bpe(_docs(spark, sf_dir), size=600))


@_query()
def bpe_vocab_audit(spark, sf_dir):
    """Entries of a trained vocabulary, and those of letters and signs alone."""
    vocabulary = tokens.vocabulary(spark, tokens.train_bpe(_docs(spark, sf_dir), size=600))
    plain = tokens.plain_tokens(vocabulary).agg(F.count(F.lit(1)).alias("n_plain"))
    return vocabulary.agg(F.count(F.lit(1)).alias("n_tokens")).join(F.broadcast(plain), how="cross")


# sources and sinks


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{spark.sparkContext.applicationId}"


@_query("select concat('', doc_id) as blob_id, text from documents")
def jsonl_round_trip(spark, sf_dir):
    """Texts as JSON Lines with further keys, read again as documents."""
    path = _folder(spark, "jsonl")
    rows = _docs(spark, sf_dir).select(F.to_json(F.struct(F.col("text").alias("content"), F.col("doc_id").cast("string").alias("blob_id"), "lang", "n_chars")).alias("value"))
    rows.write.mode("overwrite").text(path)
    return io.to_documents(io.read_raw(spark, path)).select("blob_id", "text")


@_query("select count(*) as n_rows, 6 as n_files, sum(n_chars)::bigint as n_chars, sum(doc_id)::bigint as ids from documents")
def parquet_round_trip(spark, sf_dir):
    """A table in as many files as a ratio asks for, read again file by file."""
    path = _folder(spark, "parquet")
    io.write_parquet(_docs(spark, sf_dir), path, files=io.output_files(17, 3))
    rows = io.with_file(io.read_table(spark, path))
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("file").cast("int").alias("n_files"), F.sum("n_chars").alias("n_chars"), F.sum("doc_id").alias("ids"))


@_query("select line, count(*) as n from (select unnest(string_split(text, chr(10))) as line from documents) group by line")
def text_round_trip(spark, sf_dir):
    """Texts as lines of text files, read again and counted."""
    path = _folder(spark, "text")
    io.write_text(_docs(spark, sf_dir), path)
    return io.read_text(spark, path).groupBy(F.col("value").alias("line")).agg(F.count(F.lit(1)).alias("n"))


@_query(f"""select case when {_u('split', 'doc_id')} < 0.1 then 'validation' else 'train' end as split, doc_id, (strlen(text) + 1)::int as n_tokens from documents""")
def split_round_trip(spark, sf_dir):
    """Tokens written by split, and each split read again for training."""
    path = _folder(spark, "split")
    rows = sampling.split(tokens.encode(_docs(spark, sf_dir), tokens.ByteTokenizer()))
    io.write_split(rows, path)
    return sampling.concatenate([io.read_split(spark, path, x).select(F.lit(x).alias("split"), "doc_id", F.size("input_ids").alias("n_tokens")) for x in ("train", "validation")])


# sampling


@_query(f"""select doc_id, source from (select *, row_number() over (partition by source order by {_u('sample', 'doc_id')}, doc_id) as r, count(*) over (partition by source) as n from documents)
where r <= round_even(0.1 * n, 0)""")
def sample_exact(spark, sf_dir):
    """A tenth of every source."""
    return sampling.sample_exact(_docs(spark, sf_dir).select("doc_id", "source"), 0.1, "source", "doc_id")


@_query(f"select doc_id from (select doc_id, row_number() over (order by {_u('shuffle', 'doc_id')}, doc_id) as r, count(*) over () as n from documents) where r <= floor(0.25 * n)")
def shuffle_take(spark, sf_dir):
    """The first quarter of a keyed shuffle."""
    return sampling.shuffle_take(_docs(spark, sf_dir).select("doc_id"), 0.25, "doc_id")


@_query(f"select doc_id, case when {_u('split', 'doc_id')} < 0.1 then 'validation' else 'train' end as split from documents")
def hash_split(spark, sf_dir):
    """Training and validation rows."""
    return sampling.split(_docs(spark, sf_dir).select("doc_id"))


@_query("select doc_id, (row_number() over (order by doc_id) - 1)::bigint as sequence_id, ((row_number() over (order by doc_id) - 1) % 7)::int as shard from documents")
def sequence_shard(spark, sf_dir):
    """Row numbers of whole documents, dealt out to shards."""
    return sampling.shard(sampling.number(_docs(spark, sf_dir), "doc_id"), 7).select("doc_id", "sequence_id", "shard")


@_query(f"""select source, arg_max(doc_id, pow({_u('weight', 'doc_id')}, 1.0 / n_chars)) as doc_id from documents where n_chars > 0 group by source""")
def weighted_choice(spark, sf_dir):
    """One document of every source, in proportion to its length."""
    return sampling.weighted_choice(_docs(spark, sf_dir).where("n_chars > 0"), "source", "doc_id", "n_chars", uniform(42, "weight", F.col("doc_id")))


@_query("select doc_id, source from documents union all select doc_id, source from documents where doc_id % 2 = 0")
def concatenated(spark, sf_dir):
    """Union by name of parts."""
    docs = _docs(spark, sf_dir).select("doc_id", "source")
    return sampling.concatenate([docs, docs.where("doc_id % 2 = 0").select("source", "doc_id")])


# prompts and samples


@_query(f"select doc_id, concat('<SUFFIX>', suffix, '<PREFIX>', prefix, '<MIDDLE>') as prompt, concat('<SUFFIX><PREFIX>', prefix, '<MIDDLE>') as prompt_prefix from ({corpus.FIM_SQL}) where middle <> ''")
def prompt_native(spark, sf_dir):
    """Prompts for a model of the own tokenizer."""
    p, s = F.col("prefix"), F.col("suffix")
    return predict.with_middle(fim_rows(spark, sf_dir)).select("doc_id", predict.native_prompt(p, s).alias("prompt"), predict.native_prompt(p, s, True).alias("prompt_prefix"))


@_query(f"select doc_id, concat('<｜fim▁begin｜>', prefix, '<｜fim▁hole｜>', suffix, '<｜fim▁end｜>') as prompt, concat('<｜fim▁begin｜>', prefix, '<｜fim▁hole｜><｜fim▁end｜>') as prompt_prefix from ({corpus.FIM_SQL}) where middle <> ''")
def prompt_external(spark, sf_dir):
    """Prompts for the external model family."""
    p, s = F.col("prefix"), F.col("suffix")
    return predict.with_middle(fim_rows(spark, sf_dir)).select("doc_id", predict.external_prompt(p, s).alias("prompt"), predict.external_prompt(p, s, True).alias("prompt_prefix"))


@_query(f"""select doc_id, case when {_u('order', 'doc_id')} > 0.5 then concat('<PREFIX>', prefix, '<SUFFIX>', suffix, '<MIDDLE>', middle) else concat('<SUFFIX>', suffix, '<PREFIX>', prefix, '<MIDDLE>', middle) end as mix,
concat('<PREFIX>', prefix, '<SUFFIX>', suffix, '<MIDDLE>', middle) as psm, concat('<SUFFIX>', suffix, '<PREFIX>', prefix, '<MIDDLE>', middle) as spm from ({corpus.FIM_SQL})""")
def psm_spm(spark, sf_dir):
    """Both orders, and their mixture."""
    u, parts = uniform(42, "order", F.col("doc_id")), (F.col("prefix"), F.col("middle"), F.col("suffix"))
    return fim_rows(spark, sf_dir).select("doc_id", *[fim.assemble_text(*parts, fim.psm_first(u, o)).alias(o) for o in ("mix", "psm", "spm")])


_S = _u("strategy", "doc_id")


@_query(f"""select doc_id, case when {_S} > 0.9 then 'ntp' else 'line' end as plain, case when {_S} > 0.9 then 'ntp' when {_S} > 0.7 then 'func' else 'line' end as func,
case when {_S} > 0.9 then 'ntp' when {_S} > 0.5 then 'multi' else 'line' end as multi, case when {_S} > 0.9 then 'ntp' when {_S} > 0.7 then 'func' when {_S} > 0.5 then 'multi' else 'line' end as both from documents""")
def strategy_draw(spark, sf_dir):
    """Kind of sample under all switches."""
    k = F.col("doc_id")
    return _docs(spark, sf_dir).select(
        "doc_id",
        fim.strategy_draw(k).alias("plain"),
        fim.strategy_draw(k, func_level=True).alias("func"),
        fim.strategy_draw(k, multi_line=True).alias("multi"),
        fim.strategy_draw(k, func_level=True, multi_line=True).alias("both"),
    )


_CUT = 256
_GRID = "select doc_id, (n_chars % 400)::int as p, (doc_id * 7 % 60)::int as m, (n_chars // 3 % 400)::int as s from documents"


@_query(f"""select doc_id, m, case when p < l // 2 then p when s < l - l // 2 then least(p, l - s) else l // 2 end::int as p, case when p < l // 2 then least(s, l - p) when s < l - l // 2 then s else l - l // 2 end::int as s
from (select *, {_CUT} - m - 4 as l from ({_GRID}))""")
def context_budget(spark, sf_dir):
    """Tokens of prefix and suffix that fit beside a middle."""
    rows = _docs(spark, sf_dir).selectExpr("doc_id", "cast(n_chars % 400 as int) p", "cast(doc_id * 7 % 60 as int) m", "cast((n_chars div 3) % 400 as int) s")
    p, s = fim.budget_columns(F.col("p"), F.col("m"), F.col("s"), _CUT)
    return rows.select("doc_id", "m", p.alias("p"), s.alias("s"))


@_query(f"select doc_id, (len(string_split(content, chr(10))) - 1 - case when {FULL} then 3 else 0 end)::int as n_logical, (case when {FULL} then 1 else 0 end)::int as n_multi from ({corpus.SQL})")
def logical_lines(spark, sf_dir):
    """Logical lines, and those over several physical ones."""
    rows = code_corpus(spark, sf_dir).select("doc_id", fim.logical_line_map("content").alias("m"))
    return rows.select("doc_id", F.size("m").alias("n_logical"), F.size(F.filter("m", lambda x: F.size(x) > 1)).alias("n_multi"))


_SIZE = 502  # tokens of a block: the cutoff less what is reserved
_JOINED = "concat(prefix, middle, suffix) as text"


def _samples(spark, sf_dir, kind: str, **options):
    rows = code_corpus(spark, sf_dir).withColumnRenamed("content", "text")
    return fim.samples(rows, tokens.CharTokenizer(), cutoff=512, only=kind, **options)


@_query(f"""select doc_id, (i // {_SIZE})::int as sample, substr(text, greatest(least(i, length(text) - {_SIZE}), 0)::int + 1, {_SIZE}) as text, (least(length(text), {_SIZE}) + 1)::int as n_tokens
from documents, unnest(range(0, greatest(length(text), 1), {_SIZE})) as u(i)""")
def ntp(spark, sf_dir):
    """Next-token windows of whole texts, decoded."""
    out = fim.samples(_docs(spark, sf_dir), tokens.CharTokenizer(), cutoff=512, fim=False)
    out = out.select("doc_id", "sample", F.size("input_ids").alias("n_tokens"), F.slice("input_ids", F.lit(1), F.size("input_ids") - 1).alias("ids"))
    return tokens.decode(out, tokens.CharTokenizer(), "ids").select("doc_id", "sample", "text", "n_tokens")


_SHORT_LINES = f"""select doc_id, list_filter(string_split(content, chr(10))[:-2], lambda x: length(x) < {_SIZE}) as ls from ({corpus.SQL}) where {_u('strategy', 'doc_id')} <= 0.9"""


@_query(f"""with l as ({_SHORT_LINES}), t as (
  select doc_id, array_to_string(ls, chr(10)) || case when len(ls) > 0 then chr(10) else '' end as t from l
), b as (
  select doc_id, t, least(i, greatest(length(t) - {_SIZE}, 0))::int as a, i from t, unnest(range(0, length(t), {_SIZE})) as u(i)
), p as (
  select doc_id, x, sum(length(x) + 1) over (partition by doc_id order by i) as e from (select doc_id, i, ls[i] as x from l, unnest(range(1, len(ls) + 1)) as u(i))
), c as (
  select distinct doc_id, a, i, t from b join p using (doc_id)
  where e - length(x) - 1 >= a and e <= a + {_SIZE} and length(x) + 1 < 400 and length(regexp_replace(regexp_replace(x, '^{SPACE}+', ''), '{SPACE}+$', '')) > 10
)
select doc_id, (row_number() over (partition by doc_id order by i) - 1)::int as sample, substr(t, a + 1, {_SIZE}) as text, (least(length(t), {_SIZE}) + 4)::int as n_tokens from c""")
def fim_line(spark, sf_dir):
    """Parts of one logical line to fill in, and what surrounds them, put together again."""
    return _samples(spark, sf_dir, "line").select("doc_id", "sample", F.expr(_JOINED), F.size("input_ids").alias("n_tokens"))


@_query()
def fim_multi(spark, sf_dir):
    """Runs of lines to fill in."""
    return _samples(spark, sf_dir, "multi", multi_line=True).select("doc_id", "sample", F.size("input_ids").alias("n_tokens"), "prefix", "middle", "suffix")


@_query(f"""with f as (
  select doc_id, content, case when {_u('draw1:fim', 'doc_id')} < 0.5 then {corpus.BODIES[0][0]} else {corpus.BODIES[1][0]} end as head, case when {_u('draw1:fim', 'doc_id')} < 0.5 then {corpus.BODIES[0][1]} else {corpus.BODIES[1][1]} end as middle
  from ({corpus.SQL}) where {FULL} and not {has('syntax')} and {_u('strategy', 'doc_id')} > 0.7 and {_u('strategy', 'doc_id')} <= 0.9
), p as (
  select doc_id, content, middle, (strpos(content, head) + length(head) - 1)::int as p, 512 - 4 - length(middle) as l from f where length(middle) <= 512 // 4
), b as (
  select *, length(content) - p - length(middle) as s from p
), n as (
  select *, case when p < l // 2 then p when s < l - l // 2 then least(p, l - s) else l // 2 end::int as np, case when p < l // 2 then least(s, l - p) when s < l - l // 2 then s else l - l // 2 end::int as ns from b
)
select doc_id, substr(content, p - np + 1, np) as prefix, middle, substr(content, p + length(middle) + 1, ns) as suffix, (np + length(middle) + ns + 4)::int as n_tokens from n""")
def fim_func(spark, sf_dir):
    """Function bodies to fill in, and as much around them as fits."""
    return _samples(spark, sf_dir, "func", func_level=True).select("doc_id", "prefix", "middle", "suffix", F.size("input_ids").alias("n_tokens"))


@_query()
def tokenize_pipeline(spark, sf_dir):
    """Samples of all kinds with their split."""
    rows = code_corpus(spark, sf_dir).withColumnRenamed("content", "text")
    out = pipelines.tokenize(rows, tokens.ByteTokenizer(), "fim", cutoff=512, func_level=True, multi_line=True)
    return out.select("doc_id", "sample", "strategy", "split", F.size("input_ids").alias("n_tokens"))


# prediction

def _rows(text: str) -> str:
    return f"string_split(regexp_replace({text}, '{SPACE}+$', ''), chr(10))"


_SHORTER = f"least(len({_rows('answer')}), len({_rows('middle')}))"
_AGREE = f"list_slice({_rows('answer')}, 1, {_SHORTER}) = list_slice({_rows('middle')}, 1, {_SHORTER})"


def _kept(spark, sf_dir, which: str):
    rows = predict.with_middle(fim_rows(spark, sf_dir)).withColumn("prediction", F.array("answer")).withColumnRenamed("doc_id", "sequence_id")
    return predict.keep(rows, which, with_sequence_id=True)


@_query(f"select prefix, middle, suffix, doc_id as sequence_id from ({corpus.FIM_SQL}) where middle <> '' and {_AGREE}")
def prediction_keep_correct(spark, sf_dir):
    """Rows whose completion agrees."""
    return _kept(spark, sf_dir, "correct")


@_query(f"select prefix, middle, suffix, doc_id as sequence_id from ({corpus.FIM_SQL}) where middle <> '' and not {_AGREE}")
def prediction_keep_incorrect(spark, sf_dir):
    """Rows whose completion does not agree."""
    return _kept(spark, sf_dir, "incorrect")


@_query(f"select doc_id, prefix, middle, suffix, concat('<SUFFIX>', suffix, '<PREFIX>', prefix, '<MIDDLE>') as completion from ({corpus.FIM_SQL}) where middle <> ''")
def predict_echo(spark, sf_dir):
    """Batched prediction with a model that repeats its prompt."""
    rows = predict.predict(fim_rows(spark, sf_dir).drop("answer"), lambda: lambda prompts: [[p] for p in prompts])
    return rows.select("doc_id", "prefix", "middle", "suffix", F.get("prediction", F.lit(0)).alias("completion"))
