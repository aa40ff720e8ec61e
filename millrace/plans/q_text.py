"""Queries: projections, text functions, tags, dialogues, validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import dialogue as D
from millrace.plans import views as V
from millrace.plans.catalog import register


@register("prj_pool_record", "SELECT 'part:' || p_partkey AS sample_id, 'main' AS source, trim(p_name) AS answer, 'user:' || trim(p_name) || '?|assistant:' || p_brand AS messages, 0::BIGINT AS n_relations FROM part WHERE trim(p_name) <> ''")
def prj_pool_record(spark: SparkSession, sf: str) -> DataFrame:
    p = V.table(spark, sf, "part").withColumn("name", F.trim("p_name")).where("name <> ''")
    messages = F.array(F.struct(F.lit("user").alias("role"), F.concat("name", F.lit("?")).alias("content")), F.struct(F.lit("assistant").alias("role"), F.col("p_brand").alias("content")))
    relations = F.coalesce(F.lit(None).cast("array<string>"), F.array().cast("array<string>"))
    flat = F.array_join(F.transform(messages, lambda m: F.concat_ws(":", m["role"], m["content"])), "|")
    return p.select(F.concat(F.lit("part:"), "p_partkey").alias("sample_id"), F.lit("main").alias("source"), F.col("name").alias("answer"), flat.alias("messages"), F.size(relations).cast("long").alias("n_relations"))


@register("prj_serving_json", """SELECT p_partkey, '[{"role":"user","content":"' || p_name || '\\n<image>"},{"role":"assistant","content":"' || p_brand || '"}]' AS conversations FROM part""")
def prj_serving_json(spark: SparkSession, sf: str) -> DataFrame:
    return V.table(spark, sf, "part").select("p_partkey", D.serving_conversations(F.col("p_name"), F.col("p_brand")).alias("conversations"))


@register("prj_trainer_rows", """SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN '{"messages":"' || p_name || '","images":["' || p_brand || '"]}' ELSE '{"messages":"' || p_name || '"}' END AS record FROM part""")
def prj_trainer_rows(spark: SparkSession, sf: str) -> DataFrame:
    images = F.when(F.col("p_size") % 2 == 0, F.array("p_brand"))
    return V.table(spark, sf, "part").select("p_partkey", F.to_json(F.struct(F.col("p_name").alias("messages"), images.alias("images"))).alias("record"))


@register(
    "prj_suffix_rewrite",
    f"""WITH p AS (SELECT p_partkey, p_size % 3 <> 0 AND p_size % 2 = 0 AS applies, p_name || ' ' || CASE WHEN p_partkey % 3 = 0 THEN '{D.NEW_SUFFIX}' WHEN p_partkey % 3 = 1 OR (p_size % 3 <> 0 AND p_size % 2 = 0) THEN '{D.OLD_SUFFIX}' ELSE 'No suffix' END AS text FROM part)
    SELECT p_partkey, CASE WHEN applies THEN p_name_of(text) || '{D.NEW_SUFFIX}' ELSE text END AS text, applies AND text LIKE '%{D.OLD_SUFFIX}' AS changed FROM p""".replace(
        "p_name_of(text)", f"replace(replace(text, '{D.OLD_SUFFIX}', ''), '{D.NEW_SUFFIX}', '')"
    ),
)
def prj_suffix_rewrite(spark: SparkSession, sf: str) -> DataFrame:
    """Prompts of one source and task get the new suffix; those of others keep whatever they end in."""
    source, task = F.when(F.col("p_size") % 3 != 0, "clevr").otherwise("replay"), F.when(F.col("p_size") % 2 == 0, "comparison").otherwise("count")
    p = V.table(spark, sf, "part").select("p_partkey", "p_name", source.alias("source"), task.alias("task_type"))
    applies = (F.col("source") == "clevr") & (F.col("task_type") == "comparison")
    suffix = F.when(F.col("p_partkey") % 3 == 0, D.NEW_SUFFIX).when((F.col("p_partkey") % 3 == 1) | applies, D.OLD_SUFFIX).otherwise("No suffix")
    text, changed = D.rewrite_suffix(F.concat_ws(" ", "p_name", suffix), applies, F.lit("user"), F.col("p_partkey"))
    return p.select("p_partkey", text.alias("text"), changed.alias("changed"))


@register(
    "prj_prompt",
    f"""SELECT conv_id, turn, '<image>' || chr(10) || replace(replace(q, '<image 1>', 'the image'), '<image>', 'the image') || chr(10) || '{D.CHOICE_SUFFIX}' AS prompt
    FROM (SELECT conv_id, turn, CASE conv_id % 3 WHEN 0 THEN 'See <image 1>. ' WHEN 1 THEN '<image> or <image>: ' ELSE '' END || text AS q FROM conversations WHERE role = 'user')""",
)
def prj_prompt(spark: SparkSession, sf: str) -> DataFrame:
    c = V.table(spark, sf, "conversations").where("role = 'user'")
    marked = F.when(F.col("conv_id") % 3 == 0, "See <image 1>. ").when(F.col("conv_id") % 3 == 1, "<image> or <image>: ").otherwise("")
    return c.select("conv_id", "turn", D.choice_prompt(F.concat(marked, F.col("text"))).alias("prompt"))


@register("flt_array_exists", f"WITH {V.PROGRAMS} SELECT question_id FROM programs WHERE len(list_filter(program, lambda s: s.\"function\" = 'relate' AND s.value_inputs[1] IN ('left', 'right', 'front', 'behind', 'above', 'below'))) > 0")
def flt_array_exists(spark: SparkSession, sf: str) -> DataFrame:
    p = V.programs(spark, sf)
    return p.where(F.exists("program", lambda s: (s["function"] == "relate") & F.get(s["value_inputs"], F.lit(0)).isin(*T.RELATIONS))).select("question_id")


@register("arr_filter_flatten", f"WITH {V.PROGRAMS} SELECT question_id, array_to_string(flatten(list_transform(list_filter(program, lambda s: s.\"function\" = 'relate'), lambda s: s.value_inputs)), ',') AS relations FROM programs")
def arr_filter_flatten(spark: SparkSession, sf: str) -> DataFrame:
    inputs = F.flatten(F.transform(F.filter("program", lambda s: s["function"] == "relate"), lambda s: s["value_inputs"]))
    return V.programs(spark, sf).select("question_id", F.array_join(inputs, ",").alias("relations"))


@register("flt_terminal_in", f"WITH {V.PROGRAMS} SELECT question_id, program[-1].\"function\" AS terminal FROM programs WHERE program[-1].\"function\" IN ('count', 'exist', 'query_color')")
def flt_terminal_in(spark: SparkSession, sf: str) -> DataFrame:
    terminal = F.element_at("program", -1)["function"]
    return V.programs(spark, sf).where(terminal.isin("count", "exist", "query_color")).select("question_id", terminal.alias("terminal"))


@register("flt_split_first_elem", "SELECT p_partkey, split_part(p_type, ' ', 1) AS caption FROM part WHERE p_brand = 'Brand#11' OR p_size < 10")
def flt_split_first_elem(spark: SparkSession, sf: str) -> DataFrame:
    return V.table(spark, sf, "part").where("p_brand = 'Brand#11' or p_size < 10").select("p_partkey", F.get(F.split("p_type", " "), F.lit(0)).alias("caption"))


@register("flt_first_match", "SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY CASE WHEN lang = 'de' THEN 0 ELSE 1 END, doc_id) = 1")
def flt_first_match(spark: SparkSession, sf: str) -> DataFrame:
    first = F.min(F.struct(F.when(F.col("lang") == "de", 0).otherwise(1), F.col("doc_id")))
    return V.table(spark, sf, "documents").groupBy("source").agg(first.alias("f")).select("source", "f.doc_id")


@register("str_normalise_v1", r"SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(text), '\A[\s\p{Z}\x0b]+|[\s\p{Z}\x0b]+\z', '', 'g'), '[.。]+\z', ''), '[\s\p{Z}\x0b]+', ' ', 'g'), '\A +| +\z', '', 'g') AS text FROM conversations")
def str_normalise_v1(spark: SparkSession, sf: str) -> DataFrame:
    return V.table(spark, sf, "conversations").select("conv_id", "turn", T.normalise_v1(F.col("text")).alias("text"))


@register("str_normalise_v2", r"SELECT conv_id, turn, regexp_replace(split_part(regexp_replace(lower(text), '\A[\s\p{Z}\x0b]+|[\s\p{Z}\x0b]+\z', '', 'g'), chr(10), 1), '[^\p{L}\p{N}_]+', '', 'g') AS text FROM conversations")
def str_normalise_v2(spark: SparkSession, sf: str) -> DataFrame:
    return V.table(spark, sf, "conversations").select("conv_id", "turn", T.normalise_v2(F.col("text")).alias("text"))


_LETTERS = "list_value('A', ' b. ', '(C)', '[D]。', '', 'A or B', 'AB', 'E', 'The answer is A.', 'A' || chr(10) || 'x', 'd', '(a).', '(A', '[B)')"


@register("str_parse_letter", rf"SELECT p_partkey, CASE WHEN regexp_matches(t, '\A\s*([A-Da-d]|\([A-Da-d]\)|\[[A-Da-d]\])[.。]?\s*\z') THEN upper(regexp_extract(t, '[A-Da-d]')) END AS letter FROM (SELECT p_partkey, ({_LETTERS})[(p_partkey % 14 + 1)::INTEGER] AS t FROM part)")
def str_parse_letter(spark: SparkSession, sf: str) -> DataFrame:
    texts = ["A", " b. ", "(C)", "[D]。", "", "A or B", "AB", "E", "The answer is A.", "A\nx", "d", "(a).", "(A", "[B)"]
    t = F.element_at(F.array(*map(F.lit, texts)), (F.col("p_partkey") % 14 + 1).cast("int"))
    return V.table(spark, sf, "part").select("p_partkey", T.parse_letter(t).alias("letter"))


@register(
    "str_short_answer",
    r"""SELECT p_partkey, p_partkey % 5 <> 0 AND len(string_split_regex(trim(t), '\s+')) <= 3 AND (regexp_full_match(regexp_replace(lower(t), '\A\.+|\.+\z', '', 'g'), '[a-z]+([ -][a-z]+){0,2}') OR regexp_full_match(regexp_replace(lower(t), '\A\.+|\.+\z', '', 'g'), '\pN+(\.\pN+)?')) AS short
    FROM (SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN p_type WHEN 1 THEN CAST(p_size AS VARCHAR) WHEN 2 THEN '٣.٥' WHEN 3 THEN ' two  words. ' ELSE p_brand END AS t FROM part)""",
)
def str_short_answer(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_size") % 5
    t = F.when(k == 0, F.col("p_type")).when(k == 1, F.col("p_size").cast("string")).when(k == 2, "٣.٥").when(k == 3, " two  words. ").otherwise(F.col("p_brand"))
    return V.table(spark, sf, "part").select("p_partkey", T.short_answer(t, applies=F.col("p_partkey") % 5 != 0).alias("short"))


_TASK = "CASE WHEN f LIKE 'query\\_%' ESCAPE '\\' THEN replace(f, 'query_', '') WHEN f = 'count' THEN 'count' WHEN f IN ('equal_integer', 'greater_than', 'less_than') THEN 'comparison' WHEN f IN ('exist', 'equal_color', 'equal_material', 'equal_shape', 'equal_size') THEN 'boolean_or_attribute' ELSE 'other' END"


@register("tag_task", f"WITH {V.PROGRAMS} SELECT question_id, {_TASK} AS task_type FROM (SELECT question_id, program[-1].\"function\" AS f FROM programs)")
def tag_task(spark: SparkSession, sf: str) -> DataFrame:
    return V.programs(spark, sf).select("question_id", T.task_of(F.element_at("program", -1)["function"]).alias("task_type"))


_ANSWERS = ("yes", "No", "7", "red", "metal", "cube", "large", "12a", "¼", "")
_ANSWER_SQL = "(['yes','No','7','red','metal','cube','large','12a','¼',''])[(p_partkey % 10 + 1)::INTEGER]"


@register("tag_answer", f"SELECT p_partkey, CASE WHEN lower(a) IN ('yes', 'no') THEN 'boolean' WHEN regexp_full_match(a, '[0-9]+') THEN 'integer' ELSE 'attribute' END AS answer_type FROM (SELECT p_partkey, {_ANSWER_SQL} AS a FROM part)")
def tag_answer(spark: SparkSession, sf: str) -> DataFrame:
    a = F.element_at(F.array(*map(F.lit, _ANSWERS)), (F.col("p_partkey") % 10 + 1).cast("int"))
    return V.table(spark, sf, "part").select("p_partkey", T.answer_type(a).alias("answer_type"))


@register(
    "tag_answer_group",
    f"""SELECT p_partkey, CASE WHEN regexp_full_match(a, '[0-9]+') THEN 'integer' WHEN a = 'red' THEN 'color' WHEN a = 'metal' THEN 'material' WHEN a = 'cube' THEN 'shape' WHEN a = 'large' THEN 'size' WHEN a IN ('yes', 'no') THEN 'boolean' ELSE 'other' END AS answer_group
    FROM (SELECT p_partkey, lower({_ANSWER_SQL}) AS a FROM part)""",
)
def tag_answer_group(spark: SparkSession, sf: str) -> DataFrame:
    a = F.element_at(F.array(*map(F.lit, _ANSWERS)), (F.col("p_partkey") % 10 + 1).cast("int"))
    return V.table(spark, sf, "part").select("p_partkey", T.answer_group(a).alias("answer_group"))


@register("tag_difficulty", f"WITH {V.PROGRAMS} SELECT question_id, CASE WHEN n <= 9 AND r <= 1 THEN 'easy' WHEN n <= 15 AND r <= 2 THEN 'medium' WHEN n <= 20 AND r <= 3 THEN 'hard' ELSE 'very_hard' END AS difficulty FROM (SELECT question_id, p_size AS n, len(program) - 1 AS r FROM programs)")
def tag_difficulty(spark: SparkSession, sf: str) -> DataFrame:
    return V.programs(spark, sf).select("question_id", T.difficulty(F.col("p_size"), F.size("program") - 1).alias("difficulty"))


_DIALOGUES = "m AS (SELECT conv_id, list({'role': role, 'content': regexp_replace(replace(text, '<|image_pad|>', '<image>'), '\\A\\s+|\\s+\\z', '', 'g')} ORDER BY turn, role, text) AS turns FROM conversations GROUP BY conv_id)"


@register("conv_normalise", f"WITH {_DIALOGUES} SELECT conv_id, array_to_string(list_transform(turns, lambda t: t.role || ':' || t.content), '|') AS turns FROM m")
def conv_normalise(spark: SparkSession, sf: str) -> DataFrame:
    d = D.dialogues(V.table(spark, sf, "conversations")).withColumn("turns", D.normalised())
    return d.select("conv_id", F.array_join(F.transform("turns", lambda t: F.concat_ws(":", t["role"], t["content"])), "|").alias("turns"))


@register(
    "conv_profile",
    """SELECT conv_id, count(*)::BIGINT AS n_turns, string_agg(role, ',' ORDER BY turn) AS roles, sum(length(text))::BIGINT AS n_chars, sum((length(text) - length(replace(text, 'the', ''))) // 3)::BIGINT AS n_the,
    bool_and(regexp_full_match(text, '[\\x00-\\x7f]*')) AS ascii_only, left(first(text ORDER BY turn), 180) AS preview FROM conversations GROUP BY conv_id""",
)
def conv_profile(spark: SparkSession, sf: str) -> DataFrame:
    d = D.dialogues(V.table(spark, sf, "conversations"))
    total = lambda f: F.aggregate(F.transform("messages", f), F.lit(0).cast("long"), lambda a, x: a + x)
    return d.select(
        "conv_id",
        F.size("messages").cast("long").alias("n_turns"),
        F.array_join(F.transform("messages", lambda t: t["role"]), ",").alias("roles"),
        total(lambda t: F.length(t["text"]).cast("long")).alias("n_chars"),
        total(lambda t: T.occurrences(t["text"], "the")).alias("n_the"),
        F.forall("messages", lambda t: t["text"].rlike(r"\A\p{ASCII}*\z")).alias("ascii_only"),
        F.substring(F.get("messages", F.lit(0))["text"], 1, 180).alias("preview"),
    )


#: Defects that are planted by conv_id: of roles, contents, tools and images.
_PLANTED = """p AS (SELECT conv_id, conv_id % 13 AS k, CASE WHEN conv_id % 13 < 12 THEN CASE conv_id % 13 WHEN 0 THEN NULL
    WHEN 1 THEN [{'role': 'user', 'content': NULL}, {'role': 'assistant', 'content': 'a'}] WHEN 2 THEN [{'role': 'user', 'content': 'q'}, {'role': 'assistant', 'content': ''}]
    WHEN 3 THEN [{'role': 'user', 'content': '<image> what'}, {'role': 'assistant', 'content': 'a ' || conv_id}] WHEN 4 THEN [{'role': 'user', 'content': 'q'}, {'role': 'assistant', 'content': 'b ' || conv_id}]
    WHEN 5 THEN [{'role': 'user', 'content': 'same'}, {'role': 'assistant', 'content': 'text'}] WHEN 6 THEN [{'role': 'system', 'content': 's'}, {'role': 'user', 'content': '<image>'}, {'role': 'assistant', 'content': 'c ' || conv_id}]
    WHEN 7 THEN [{'role': 'user', 'content': 'q'}, {'role': 'assistant', 'content': 'd ' || conv_id}] WHEN 8 THEN [{'role': 'user', 'content': 'q'}, {'role': 'assistant', 'content': 'e ' || conv_id}]
    WHEN 9 THEN [{'role': 'user', 'content': 'q <image> <image>'}, {'role': 'assistant', 'content': 'f'}] WHEN 10 THEN [{'role': 'assistant', 'content': 'x'}]
    WHEN 11 THEN [{'role': 'user', 'content': 'q'}, {'role': 'assistant', 'content': 'g ' || conv_id}] END ELSE turns END AS turns FROM m)"""


@register(
    "conv_reason_codes",
    f"""WITH {_DIALOGUES}, {_PLANTED}, f AS (SELECT *, CASE WHEN k IN (3, 6, 7, 11) THEN 1 WHEN k = 8 THEN 2 ELSE 0 END AS images, k = 7 AS placeholder, k = 6 AND conv_id % 2 = 0 AS broken, array_to_string(list_transform(turns, lambda t: t.role), ',') AS roles,
        list_filter(turns, lambda t: t.role = 'user')[1].content AS u, turns[-1].content AS a, list_sum(list_transform(turns, lambda t: (length(t.content) - length(replace(t.content, '<image>', ''))) // 7)) AS marks FROM p),
    r AS (SELECT *, CASE WHEN turns IS NULL THEN 'invalid_dialogue' WHEN roles NOT IN ('user,assistant', 'system,user,assistant') THEN 'unsupported_dialogue' WHEN len(list_filter(turns, lambda t: t.content IS NULL)) > 0 THEN 'invalid_content'
        WHEN k = 4 THEN 'tool_sample' WHEN u = '' OR a = '' OR contains(a, '<image>') THEN 'invalid_qa' WHEN images > 1 THEN 'multi_image' WHEN images = 1 AND broken THEN 'parse_or_image_error'
        WHEN (marks = 1 AND contains(u, '<image>') AND images = 1 AND NOT placeholder) OR (marks = 0 AND (images = 0 OR placeholder)) THEN 'accepted' ELSE 'ambiguous_modality' END AS reason FROM f),
    d AS (SELECT CASE WHEN reason = 'accepted' AND row_number() OVER (PARTITION BY reason, turns::VARCHAR ORDER BY conv_id) > 1 THEN 'duplicate' ELSE reason END AS reason FROM r)
    SELECT reason, count(*)::BIGINT AS n FROM d GROUP BY 1""",
)
def conv_reason_codes(spark: SparkSession, sf: str) -> DataFrame:
    """Dialogues with planted defects by the first reason to reject them; copies of accepted ones are duplicates."""
    d = D.dialogues(V.table(spark, sf, "conversations")).select("conv_id", (F.col("conv_id") % 13).alias("k"), D.normalised().alias("own"))
    turn = lambda role, text: F.struct(F.lit(role).alias("role"), text.cast("string").alias("content"))
    pair = lambda user, answer: F.array(turn("user", user), turn("assistant", answer))
    own = lambda letter: F.concat(F.lit(letter + " "), F.col("conv_id"))
    q = F.lit("q")
    planted = {
        0: F.lit(None),
        1: pair(F.lit(None), F.lit("a")),
        2: pair(q, F.lit("")),
        3: pair(F.lit("<image> what"), own("a")),
        4: pair(q, own("b")),
        5: pair(F.lit("same"), F.lit("text")),
        6: F.array(turn("system", F.lit("s")), turn("user", F.lit("<image>")), turn("assistant", own("c"))),
        7: pair(q, own("d")),
        8: pair(q, own("e")),
        9: pair(F.lit("q <image> <image>"), F.lit("f")),
        10: F.array(turn("assistant", F.lit("x"))),
        11: pair(q, own("g")),
    }
    kind = "array<struct<role:string,content:string>>"
    turns = F.col("own").cast(kind)
    for k, value in planted.items():
        turns = F.when(F.col("k") == k, value.cast(kind)).otherwise(turns)
    images = F.when(F.col("k").isin(3, 6, 7, 11), 1).when(F.col("k") == 8, 2).otherwise(0)
    d = d.withColumn("turns", turns)
    broken = (F.col("k") == 6) & (F.col("conv_id") % 2 == 0)
    d = d.withColumn("reason", D.reason("turns", F.col("k") == 4, images, F.col("k") == 7, broken)).withColumn("sample_id", F.sha2(F.to_json("turns"), 256))
    return D.with_duplicates(d, "sample_id", "conv_id").groupBy("reason").agg(F.count("*").alias("n"))


_SERVED = """CASE p_partkey % 6 WHEN 0 THEN '[{"role":"user","content":"q <image>"},{"role":"assistant","content":"a"}]' WHEN 1 THEN '[]' WHEN 2 THEN 'not json' WHEN 3 THEN '[{"role":"robot","content":"q"}]'
    WHEN 4 THEN '[{"role":"user","content":"q"}]' ELSE '[{"role":"user"}]' END"""


_IMAGE = "CASE p_size % 4 WHEN 0 THEN '89504E470D0A1A0A0000000049454E44AE426082' WHEN 1 THEN 'FFD8FFE000104A46' WHEN 2 THEN 'FFD8FFE0FFD9' END"


@register(
    "val_conversations",
    """SELECT error, count(*)::BIGINT AS n FROM (SELECT unnest(list_concat(CASE p_partkey % 6 WHEN 0 THEN []::VARCHAR[] WHEN 1 THEN ['conversations_not_nonempty_list'] WHEN 2 THEN ['invalid_conversations_json'] WHEN 3 THEN ['invalid_role']
    WHEN 4 THEN ['missing_image_token', 'missing_assistant_turn'] ELSE ['content_not_string'] END, CASE p_size % 4 WHEN 1 THEN ['invalid_image_bytes'] WHEN 3 THEN ['missing_image_bytes'] ELSE [] END)) AS error FROM part) GROUP BY error""",
)
def val_conversations(spark: SparkSession, sf: str) -> DataFrame:
    p = V.table(spark, sf, "part").select(F.expr(_SERVED).alias("conversations"), F.array(F.unhex(F.expr(_IMAGE))).alias("images"))
    errors = p.select(F.explode(D.conversation_errors(F.col("conversations"), F.col("images"))).alias("error"))
    return errors.groupBy("error").agg(F.count("*").alias("n"))


@register(
    "val_manifest",
    """WITH r AS (SELECT p_partkey AS id, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_name END AS question, CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_brand END AS answer, p_size FROM part),
    e AS (SELECT id, unnest(CASE WHEN question IS NULL OR answer IS NULL THEN ['missing_fields:' || concat_ws(',', CASE WHEN question IS NULL THEN 'question' END, CASE WHEN answer IS NULL THEN 'answer' END)]
        ELSE list_concat(CASE WHEN p_size > 40 THEN ['program_too_long'] ELSE [] END, CASE WHEN id % 11 = 0 THEN ['image_not_found'] ELSE [] END) END) AS error FROM r)
    SELECT error, count(*)::BIGINT AS n FROM e GROUP BY error UNION ALL SELECT 'duplicates', (count(*) - count(DISTINCT question))::BIGINT FROM r WHERE question IS NOT NULL""",
)
def val_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Manifest errors: missing fields hide the others; files are looked up in a listing."""
    p = V.table(spark, sf, "part")
    r = p.select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 5 != 0, F.col("p_name")).alias("question"), F.when(F.col("p_size") % 7 != 0, F.col("p_brand")).alias("answer"), "p_size")
    listing = p.where("p_partkey % 11 <> 0").select(F.col("p_partkey").alias("id"), F.lit(True).alias("found"))
    missing = F.concat_ws(",", F.when(F.col("question").isNull(), "question"), F.when(F.col("answer").isNull(), "answer"))
    other = F.array_compact(F.array(F.when(F.col("p_size") > 40, "program_too_long"), F.when(F.col("found").isNull(), "image_not_found")))
    errors = F.when(missing != "", F.array(F.concat(F.lit("missing_fields:"), missing))).otherwise(other)
    counted = r.join(listing, "id", "left").select(F.explode(errors).alias("error")).groupBy("error").agg(F.count("*").alias("n"))
    named = r.where("question is not null").agg((F.count("*") - F.count_distinct("question")).alias("n")).select(F.lit("duplicates").alias("error"), "n")
    return counted.unionByName(named)


@register("hash_sample_id", "SELECT conv_id, 'text:' || sha256(string_agg(role || chr(31) || text, chr(30) ORDER BY turn)) AS sample_id FROM conversations GROUP BY conv_id")
def hash_sample_id(spark: SparkSession, sf: str) -> DataFrame:
    flat = F.array_join(F.transform("messages", lambda t: F.concat_ws("\x1f", t["role"], t["text"])), "\x1e")
    return D.dialogues(V.table(spark, sf, "conversations")).select("conv_id", F.concat(F.lit("text:"), F.sha2(flat, 256)).alias("sample_id"))


@register("img_format_from_magic", "SELECT p_partkey, (['JPEG', 'PNG', 'WEBP', NULL])[(p_partkey % 4 + 1)::INTEGER] AS format FROM part")
def img_format_from_magic(spark: SparkSession, sf: str) -> DataFrame:
    heads = ["FFD8FFE000104A464946", "89504E470D0A1A0A0000", "52494646000000005745425056503820", "474946383961"]
    magic = F.unhex(F.element_at(F.array(*map(F.lit, heads)), (F.col("p_partkey") % 4 + 1).cast("int")))
    return V.table(spark, sf, "part").select("p_partkey", T.image_format(magic).alias("format"))
