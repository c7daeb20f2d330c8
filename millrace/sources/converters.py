"""Rows of single data sets made into examples: one function a set, DataFrame in, examples out (key, source, state,
questions, answers, tags). Rows that a set's rules turn away give no example. All draws are hashes of the row's key, so
they do not depend on order or partitioning. `key` is a column of every input."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions.text import SPACED, stable_hash, stripped, unit_draw
from millrace.operators.examples import in_hash_order, pretty, sample_labels, word_window
from millrace.operators.questions import answer, choice, example, label, score

CONVERTERS: dict[str, Callable[..., DataFrame]] = {}
YES_NO = ["yes", "no"]
#: Label ids with their texts for three-way inference; labels of other sets.
INFERENCE = {"entailment": "definitely true", "neutral": "might be true or false", "contradiction": "definitely false"}
NO_TOOL, CLARIFY = ("__no_tool__", "no tool is needed"), ("__clarify__", "ask for missing details")
GERMAN = r"(?iU)\b(und|nicht|ist|der|die|das|ich|wie|sind|mit|für|auf|eine|einen|dem)\b"
DECLINES = r"(I'm sorry|I am sorry|I apologize|I'm unable|I am unable|I can't|I cannot|don't have the (capability|ability)|not able to)"
SENTIMENTS = {"positive": "positive", "negative": "negative", "neutral": "neutral", "ambiguous": "mixed or ambiguous"}
ASPECTS = ["helpfulness", "honesty", "instruction_following", "truthfulness"]
RATED = ["helpfulness", "correctness", "coherence", "complexity", "verbosity"]
MARKET = ["bearish", "bullish", "neutral"]
FIELDS = {
    "cs": "cs.", "math": "math.", "stat": "stat.", "q-bio": "q-bio.", "q-fin": "q-fin.", "econ": "econ.", "eess": "eess.", "astro-ph": "astro-ph",
    "cond-mat": "cond-mat", "hep": "hep-", "gr-qc": "gr-qc", "nucl": "nucl-", "quant-ph": "quant-ph", "physics": "physics.", "nlin": "nlin.",
}


def converter(f):
    CONVERTERS[f.__name__] = f
    return f


def _labels(names) -> Column:
    pairs = names.items() if isinstance(names, dict) else [(n, n) for n in names]
    return F.array(*[label(a, b) for a, b in pairs])


def _array(names) -> Column:
    return F.array(*map(F.lit, names))


def _from_pool(rows: DataFrame, source: str, state: Column, pool: list[str], gold: Column, least: int, most: int, name: str, text: str, tags=(), texts: Callable = lambda c: c, more=(), none_fits=False) -> DataFrame:
    """A choice among sampled labels of a pool; gold null: the null answer if none_fits, else no example. texts: from a label's name to its text."""
    key = F.col("key")
    rows = rows if none_fits else rows.where(gold.isNotNull())
    n = (least + stable_hash(source, "n", key) % (most - least + 1)).cast("int")
    without = F.slice(in_hash_order(_array(pool), source, "pick", key), F.lit(1), n)
    offered = F.when(gold.isNull(), without).otherwise(sample_labels(_array(pool), gold, key, source, least, min(most, len(pool))))
    rows = rows.select("*", gold.alias("__gold"), offered.alias("__offered"))
    shown = F.transform("__offered", lambda c: label(c, texts(c)))
    qs = [choice(name, text, shown), *[q for q, _ in more]]
    answers = {name: answer(F.col("__gold"))} | {k: v for _, pair in more for k, v in [pair]}
    return rows.select(*example(key, source, state, qs, answers, tags))


def _at(names: list[str], index: Column) -> Column:
    """The name at an index from 0; null beyond them."""
    return F.when((index >= 0) & (index < len(names)), F.element_at(_array(names), (index + 1).cast("int")))


def _inference(rows: DataFrame, source: str, premise: str, claim: str, gold: Column) -> DataFrame:
    """Half of the rows ask three ways; the others yes or no, where neutral is the null answer. Empty sides give nothing."""
    rows = rows.select("*", stripped(F.col(premise)).alias("__p"), stripped(F.col(claim)).alias("__c"), gold.alias("__g"))
    rows = rows.where("__g is not null and length(__p) > 0 and length(__c) > 0")
    key, three = F.col("key"), unit_draw(source, "form", F.col("key")) < 0.5
    neutral = F.col("__g") == "neutral"
    asked = F.concat(F.lit("Is this claim true, given the text? "), F.col("__c"))
    question = F.when(three, choice("claim", asked, _labels(INFERENCE))).otherwise(choice("claim", asked, _labels(YES_NO)))
    said = F.when(three, F.col("__g")).when(F.col("__g") == "entailment", "yes").when(~neutral, "no")
    tags = F.when(three, _array(["nli3"])).when(neutral, _array(["nli2", "null:nli_neutral"])).otherwise(_array(["nli2"]))
    return rows.select(*example(key, source, F.col("__p"), [question], {"claim": answer(said)}, tags))


@converter
def mnli(rows):
    """label 0, 1 or 2; the genre fiction goes."""
    gold = _at(list(INFERENCE), F.col("label"))
    return _inference(rows.where("genre is null or genre <> 'fiction'"), "mnli", "premise", "hypothesis", gold)


@converter
def scitail(rows):
    """Half ask whether the text supports the sentence, the others as inference does; two gold labels."""
    rows = rows.where("gold_label in ('entailment', 'neutral')")
    two = unit_draw("scitail", "two", F.col("key")) < 0.5
    other = _inference(rows.where(~two), "scitail", "sentence1", "sentence2", F.col("gold_label"))
    names = {"entailment": "supported by the text", "neutral": "not supported by the text"}
    asked = choice("claim", F.concat(F.lit("Does the text support this? "), stripped(F.col("sentence2"))), _labels(names))
    plain = rows.where(two).select(*example(F.col("key"), "scitail", stripped(F.col("sentence1")), [asked], {"claim": answer(F.col("gold_label"))}, ["nli2way"]))
    return other.unionByName(plain)


def _multiple_choice(rows: DataFrame, source: str, state: str, ids: Column, texts: Column, gold: Column, text="Which answer is correct?", name="answer") -> DataFrame:
    """Gold must be offered, and no two options alike but for case and outer white space."""
    rows = rows.select("*", ids.alias("__ids"), texts.alias("__texts"), gold.alias("__gold"))
    folded = F.transform("__texts", lambda t: F.lower(stripped(t)))
    rows = rows.where(F.array_contains("__ids", F.col("__gold")) & (F.size(F.array_distinct(folded)) == F.size("__texts")))
    shown = F.zip_with("__ids", "__texts", lambda a, b: label(a, b))
    return rows.select(*example(F.col("key"), source, F.col(state), [choice(name, text, shown)], {name: answer(F.col("__gold"))}))


@converter
def commonsense_qa(rows):
    return _multiple_choice(rows, "commonsense_qa", "question", F.col("choices.label"), F.col("choices.text"), F.col("answerKey"))


@converter
def openbookqa(rows):
    return _multiple_choice(rows, "openbookqa", "question_stem", F.col("choices.label"), F.col("choices.text"), F.col("answerKey"))


@converter
def winogrande(rows):
    texts = F.array("option1", "option2")
    return _multiple_choice(rows, "winogrande", "sentence", _array(["1", "2"]), texts, F.col("answer"), "What does the blank stand for?", "referent")


@converter
def casehold(rows):
    """Five holdings cut to 200 characters, all different."""
    names = [f"h{i}" for i in range(5)]
    texts = F.array(*[F.substring(stripped(F.col(f"holding_{i}").cast("string")), 1, 200) for i in range(5)])
    rows = rows.withColumn("citing_prompt", stripped(F.col("citing_prompt")))
    gold = F.concat(F.lit("h"), F.col("label").cast("int"))
    return _multiple_choice(rows, "casehold", "citing_prompt", _array(names), texts, gold, "Which holding does the marked citation stand for?", "holding")


@converter
def clinc(rows, names: list[str]):
    """names: intents by index, `oos` among them; out of scope is the null answer."""
    rows = rows.withColumn("__name", _at(names, F.col("intent"))).where("__name is not null")
    gold = F.when(F.col("__name") != "oos", F.col("__name"))
    tags = F.when(gold.isNull(), _array(["null:oos"])).otherwise(F.array().cast("array<string>"))
    pool = [n for n in names if n != "oos"]
    return _from_pool(rows, "clinc_oos", F.col("text"), pool, gold, 4, 24, "intent", "What does the user want?", tags, lambda c: pretty(c, {"": ""}), none_fits=True)


@converter
def massive(rows, intents: list[str], scenarios: list[str]):
    """Two questions a row: the intent among sampled ones, the scenario among all."""
    domain = choice("domain", "Which domain is this about?", _labels(scenarios)), ("domain", answer(_at(scenarios, F.col("scenario"))))
    gold = _at(intents, F.col("intent"))
    return _from_pool(rows, "massive", F.col("utt"), intents, gold, 6, 24, "intent", "What does the user want?", ["multiq"], lambda c: pretty(c, {"": ""}), [domain])


@converter
def banking77(rows, names: list[str]):
    return _from_pool(rows, "banking77", F.col("text"), names, _at(names, F.col("label")), 6, 24, "intent", "What does the customer want?", (), lambda c: pretty(c, {"": ""}))


@converter
def go_emotions(rows, names: list[str], sentiment: dict[str, str]):
    """Rows with a single label; sentiment: from emotion to one of SENTIMENTS."""
    rows = rows.where(F.size("labels") == 1)
    gold = _at(names, F.col("labels")[0])
    table = F.create_map(*[F.lit(x) for pair in sentiment.items() for x in pair])
    tone = choice("sentiment", "What is the overall sentiment?", _labels(SENTIMENTS)), ("sentiment", answer(table[gold]))
    return _from_pool(rows, "go_emotions", F.col("text"), names, gold, 6, 28, "emotion", "Which emotion does the writer express?", ["multiq"], more=[tone])


@converter
def civil_comments(rows, attributes: list[str], most_chars: int = 3000, one_in: int = 10):
    """Toxic rows (0.3 or more) and one in ten of the others, 3000 characters at most; toxicity and one more score."""
    rows = rows.where(F.length("text") <= most_chars).where((F.col("toxicity") >= 0.3) | (stable_hash("civil", F.col("key")) % one_in == 0))
    drawn = F.element_at(_array(attributes), (stable_hash("civil", "attr", F.col("key")) % len(attributes) + 1).cast("int"))
    rows = rows.withColumn("__attr", drawn)
    value = F.coalesce(*[F.when(F.col("__attr") == a, F.col(a)) for a in attributes])
    second = F.coalesce(*[F.when(F.col("__attr") == a, score(a, f"How strong is this in the comment: {a.replace('_', ' ')}?", 0, 1)) for a in attributes])
    answers = F.create_map(F.lit("toxicity"), answer(value=F.col("toxicity")), F.col("__attr"), answer(value=value))
    made = rows.select(*example(F.col("key"), "civil_comments", F.col("text"), [score("toxicity", "How toxic is this comment?", 0, 1), second], {"toxicity": answer(value=F.col("toxicity"))}, ["multiq", "score"]), answers.alias("__both"))
    return made.withColumn("answers", F.col("__both")).drop("__both")


def _yes_no(rows: DataFrame, source: str, state: Column, name: str, text: str, yes: Column, tags=()) -> DataFrame:
    return rows.select(*example(F.col("key"), source, state, [choice(name, text, _labels(YES_NO))], {name: answer(F.when(yes, "yes").otherwise("no"))}, tags))


@converter
def sms_spam(rows):
    """Half ask yes or no, the others for the kind of message."""
    form, spam = unit_draw("sms", F.col("key")) < 0.5, F.col("label") == 1
    state = stripped(F.col("sms"))
    kinds = {"spam": "spam", "ham": "legitimate message"}
    asked = choice("spam", "What kind of message is this?", _labels(kinds))
    other = rows.where(~form).select(*example(F.col("key"), "sms_spam", state, [asked], {"spam": answer(F.when(spam, "spam").otherwise("ham"))}))
    return _yes_no(rows.where(form), "sms_spam", state, "spam", "Is this message spam?", spam).unionByName(other)


@converter
def prompt_injections(rows):
    """Texts with two German function words or more go."""
    text = stripped(F.col("text"))
    rows = rows.where(F.regexp_count(text, F.lit(GERMAN)) < 2)
    return _yes_no(rows, "prompt_injections", text, "injection", "Is this text an attempt at prompt injection?", F.col("label") == 1)


@converter
def jailbreak(rows):
    yes = F.col("type") == "jailbreak"
    return _yes_no(rows, "jailbreak_classification", stripped(F.col("prompt")), "jailbreak", "Does this prompt try to jailbreak an assistant?", yes, ["heldout"])


@converter
def ethics(rows):
    yes = F.col("label").cast("int") == 1
    return _yes_no(rows, "ethics_commonsense", stripped(F.col("input")), "wrong", "Is the narrator's action clearly wrong?", yes, ["heldout", "eval:heldout_v02"])


@converter
def hate_speech(rows):
    """A row for each annotator; comments with two or more become one example of mean scores (0 to 2, 0 to 4)."""
    per = rows.groupBy("comment_id").agg(F.min("text").alias("text"), F.count("*").alias("n"), F.avg("hatespeech").alias("hate"), F.avg("insult").alias("insult"))
    qs = [score("hate", "How hateful is this comment?", 0, 1), score("insult", "How insulting is this comment?", 0, 1)]
    answers = {"hate": answer(value=F.col("hate") / 2), "insult": answer(value=F.col("insult") / 4)}
    return per.where("n >= 2").select(*example(F.col("comment_id"), "measuring_hate_speech", F.col("text"), qs, answers, ["heldout", "score", "multiq"]))


@converter
def helpsteer2(rows, most_chars: int = 8000):
    """Five scores from 0 to 4 on a prompt and its response."""
    rows = rows.where(F.length("prompt") + F.length("response") <= most_chars)
    prompt = stripped(F.regexp_replace("prompt", r"<extra_id_1>(User|Assistant)\n?", "\n$1: "))
    prompt = F.when(prompt.startswith("User:") | prompt.startswith("Assistant:"), prompt).otherwise(F.concat(F.lit("User: "), prompt))
    state = F.concat(prompt, F.lit("\nAssistant: "), stripped(F.col("response")))
    qs = [score(k, f"How would you rate the response for {k}?", 0, 4, 1) for k in RATED]
    return rows.select(*example(F.col("key"), "helpsteer2", state, qs, {k: answer(value=F.col(k)) for k in RATED}, ["multiq", "score"]))


@converter
def ultrafeedback(rows, most_chars: int = 6000, taken: int = 2):
    """Two completions of each instruction by a hash order; a rating that is no whole number is the null answer.

    completions: array of (response, ratings map by aspect)."""
    each = rows.select("key", "instruction", F.posexplode("completions").alias("pos", "c")).where(F.coalesce(F.length("c.response"), F.lit(0)) < most_chars)
    spot = F.row_number().over(W.partitionBy("key").orderBy(stable_hash("uf", F.col("key"), F.col("pos")), "pos"))
    each = each.withColumn("__n", spot).where(F.col("__n") <= taken).withColumn("__key", F.concat_ws(":", "key", "pos"))
    rating = {k: F.col("c.ratings")[k] for k in ASPECTS}
    qs = [score(k, f"How would you rate the response for {k.replace('_', ' ')}?", 1, 5, 1) for k in ASPECTS]
    answers = {k: answer(value=F.when(r.rlike(r"^\d+$"), r.cast("double"))) for k, r in rating.items()}
    state = F.concat(F.lit("User: "), stripped(F.col("instruction")), F.lit("\nAssistant: "), stripped(F.coalesce("c.response", F.lit(""))))
    return each.select(*example(F.col("__key"), "ultrafeedback", state, qs, answers, ["multiq", "score"]))


def _tools(rows: DataFrame, source: str, state: Column, functions: Column, gold: Column, tags: Column) -> DataFrame:
    """functions: array of (name, description). The gold tool must be offered and label texts differ."""
    text = lambda f: F.substring(F.concat_ws(": ", f["name"], f["description"]), 1, 200)
    offered = F.concat(F.transform(functions, lambda f: label(f["name"], text(f))), F.array(label(*NO_TOOL), label(*CLARIFY)))
    rows = rows.select("*", state.alias("__state"), offered.alias("__offered"), gold.alias("__gold"), tags.alias("__tags"))
    folded = F.transform("__offered", lambda x: F.lower(stripped(x["text"])))
    rows = rows.where(F.exists("__offered", lambda x: x["id"] == F.col("__gold")) & (F.size(F.array_distinct(folded)) == F.size("__offered")))
    return rows.select(*example(F.col("key"), source, F.col("__state"), [choice("tool", "Which tool should be used first?", F.col("__offered"))], {"tool": answer(F.col("__gold"))}, F.col("__tags")))


FUNCTIONS = "array<struct<name: string, description: string>>"


def embedded_objects(text: Column, schema: str) -> Column:
    """The JSON objects of a text that start a line, read with a schema; what is none is left out."""
    parts = F.split(text, r"\n+(?=\{)")
    return F.filter(F.transform(parts, lambda p: F.from_json(F.regexp_extract(p, r"(?s)^[^{]*(\{.*\})", 1), schema)), lambda x: x.isNotNull())


@converter
def glaive(rows, most_tools: int = 30):
    """The assistant's first move: a call, a refusal (no tool), a question (clarify); any other move gives nothing."""
    rows = rows.where(F.contains("system", F.lit("Use them if required")))
    told = F.substring_index("system", "Use them if required", -1)
    tools = F.filter(embedded_objects(told, "name string, description string"), lambda f: f["name"].isNotNull())
    turns = F.split(stripped(F.col("chat")), r"\n\n\n(?=USER:|ASSISTANT:|FUNCTION RESPONSE:)")
    rows = rows.select("key", tools.alias("__tools"), turns.alias("__turns")).where((F.size("__tools").between(1, most_tools)) & (F.size("__turns") >= 2) & F.col("__turns")[0].startswith("USER:"))
    rest = F.slice("__turns", F.lit(2), F.size("__turns"))
    says = F.transform(rest, lambda t: t.startswith("USER:"))
    until = F.when(F.array_contains(says, True), F.array_position(says, F.lit(True)).cast("int") - 1).otherwise(F.size(rest))
    rows = rows.withColumn("__reply", F.slice(rest, F.lit(1), until))
    first = F.coalesce(F.try_element_at("__reply", F.lit(1)), F.lit(""))
    call = F.regexp_extract(F.array_join("__reply", "\n"), r'<functioncall>\s*\{"name":\s*"([^"]+)"', 1)
    rows = rows.withColumns({"__call": call, "__first": first})
    refuses, asks = F.col("__first").rlike(DECLINES), F.rtrim(F.replace("__first", F.lit("<|endoftext|>"), F.lit(""))).endswith("?")
    gold = F.when(F.col("__call") != "", F.col("__call")).when(refuses, NO_TOOL[0]).when(asks, CLARIFY[0])
    tag = F.when(F.col("__call") != "", "tool:call").when(refuses, "tool:none").otherwise("tool:clarify")
    state = F.concat(F.lit("User: "), stripped(F.substring(F.col("__turns")[0], 6, 1 << 30)))
    return _tools(rows, "glaive_fc_v2", state, F.col("__tools"), gold, F.array(F.lit("tool"), tag))


@converter
def toolace(rows, most_tools: int = 30):
    """Conversations whose first reply calls one tool alone. conversations: array of (from, value)."""
    told = F.regexp_extract("system", r"(?s)invoke:.*?(\[.*\])", 1)
    c = F.col("conversations")
    reply = stripped(c[1]["value"])
    names = F.array_distinct(F.transform(F.regexp_extract_all(reply, F.lit(r"(?:^\[|,\s*)([A-Za-z0-9_ .\-]+?)\("), F.lit(1)), lambda x: F.trim(x)))
    rows = rows.where((F.size(c) >= 2) & (c[0]["from"] == "user") & (c[1]["from"] == "assistant") & reply.startswith("["))
    rows = rows.select("key", F.from_json(told, FUNCTIONS).alias("__tools"), names.alias("__names"), c[0]["value"].alias("__said"))
    rows = rows.where(F.size("__tools").between(1, most_tools) & (F.size("__names") == 1))
    state = F.concat(F.lit("User: "), stripped(F.col("__said")))
    return _tools(rows, "toolace", state, F.col("__tools"), F.col("__names")[0], _array(["tool", "tool:call"]))


@converter
def bios(rows, names: list[str]):
    gold = _at(names, F.col("profession"))
    return _from_pool(rows, "bias_in_bios", stripped(F.col("hard_text")), names, gold, 5, 28, "occupation", "What is this person's occupation?", ["heldout"], lambda c: pretty(c, {"": ""}))


@converter
def qasper(rows, enough: int = 700):
    """Questions on papers, by unanimous annotators: all find it unanswerable, or all say the same yes or no with evidence.

    rows: key, title, paragraphs (array of strings), qas (array of (question, answers: array of (unanswerable, yes_no,
    evidence array))). The state is the evidence and filler paragraphs, drawn by hash until `enough` words, in document order."""
    asked = rows.select("key", "title", "paragraphs", F.posexplode("qas").alias("qi", "qa"))
    a = F.col("qa.answers")
    none = F.forall(a, lambda x: x["unanswerable"])
    said = F.array_distinct(F.transform(a, lambda x: x["yes_no"]))
    clear = ~F.exists(a, lambda x: x["unanswerable"]) & (F.size(said) == 1) & said[0].isNotNull()
    quoted = F.when(none, F.array().cast("array<string>")).otherwise(F.flatten(F.transform(a, lambda x: x["evidence"])))
    asked = asked.where(F.size(a) > 0).select("key", "title", "paragraphs", "qi", F.trim("qa.question").alias("asked"), none.alias("none"), clear.alias("clear"), said[0].alias("said"), quoted.alias("quoted"))
    asked = asked.where("none or clear")
    parts = asked.select("key", "qi", "quoted", F.posexplode("paragraphs").alias("place", "par")).where(F.length("par") > 80)
    parts = parts.withColumn("hit", F.array_contains("quoted", F.col("par"))).withColumn("n", F.regexp_count("par", F.lit(SPACED)))
    w = W.partitionBy("key", "qi").orderBy(F.desc("hit"), stable_hash("qasper", F.col("key"), F.col("qi"), F.col("place")), "place")
    before = F.coalesce(F.sum("n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = parts.withColumn("before", before).where(F.col("hit") | (F.col("before") <= enough))
    body = F.transform(F.array_sort(F.collect_list(F.struct("place", "par"))), lambda x: x["par"])
    made = parts.groupBy("key", "qi").agg(body.alias("body"), F.max("hit").alias("found"))
    made = asked.join(made, ["key", "qi"]).where("none or found")
    state = F.concat_ws("\n\n", F.array(F.col("title")), F.col("body"))
    tags = F.when(F.col("none"), _array(["null:unanswerable", "long"])).otherwise(_array(["long"]))
    said = F.when(~F.col("none"), F.when(F.col("said"), "yes").otherwise("no"))
    made = made.withColumn("__key", F.concat_ws(":", "key", "qi"))
    return made.select(*example(F.col("__key"), "qasper", state, [choice("answer", F.col("asked"), _labels(YES_NO))], {"answer": answer(said)}, tags))


@converter
def contract_nli(rows, window: int = 320):
    """rows: key, text, at (the place of the first evidence word, or null), hyp, choice. A window of words that holds the evidence."""
    words = F.regexp_extract_all("text", F.lit(f"({SPACED})"))
    drawn = (unit_draw("contract", F.col("key")) * F.size(words)).cast("int")
    state = word_window(words, F.coalesce(F.col("at"), drawn), window)
    asked = F.concat(F.lit("Does this excerpt state the following? "), F.rtrim(F.col("hyp")))
    said = F.when(F.col("choice") == "Entailment", "yes").when(F.col("choice") == "Contradiction", "no")
    tags = F.when(said.isNull(), _array(["heldout", "eval:heldout_v02", "null:not_mentioned"])).otherwise(_array(["heldout", "eval:heldout_v02"]))
    rows = rows.where("choice in ('Entailment', 'Contradiction', 'NotMentioned')")
    return rows.select(*example(F.col("key"), "contract_nli", state, [choice("clause", asked, _labels(YES_NO))], {"clause": answer(said)}, tags))


@converter
def fin_topic(rows, names: list[str]):
    gold = _at(names, F.col("label").cast("int"))
    return _from_pool(rows, "fin_tweets_topic", stripped(F.col("text")), names, gold, 6, 20, "topic", "What is this post about?", ["heldout", "eval:heldout_v02"], lambda c: F.replace(c, F.lit(" | "), F.lit(" / ")))


@converter
def fin_sentiment(rows):
    gold = _at(MARKET, F.col("label").cast("int"))
    asked = choice("sentiment", "What market sentiment does this post express?", _labels(MARKET))
    return rows.where(gold.isNotNull()).select(*example(F.col("key"), "fin_tweets_sentiment", stripped(F.col("text")), [asked], {"sentiment": answer(gold)}, ["heldout", "eval:heldout_v02"]))


@converter
def arxiv_field(rows, per_field: int = 70):
    """The field by the first category's prefix; at most per_field papers of a field, by a hash order. key: the paper's id."""
    first = F.split(F.trim("categories"), r"\s+")[0]
    field = F.coalesce(*[F.when(first.startswith(p), F.lit(name)) for name, p in FIELDS.items()])
    spot = F.row_number().over(W.partitionBy("__field").orderBy(stable_hash("arxiv", F.col("key")), "key"))
    rows = rows.withColumn("__field", field).where("__field is not null").withColumn("__n", spot).where(F.col("__n") <= per_field)
    squeezed = lambda c: stripped(F.regexp_replace(c, r"\s+", " "))
    state = F.concat(squeezed("title"), F.lit("\n\n"), squeezed("abstract"))
    return _from_pool(rows, "arxiv_field", state, list(FIELDS), F.col("__field"), 5, 15, "field", "Which research field is this paper from?", ["heldout", "eval:heldout_v02"])


@converter
def clickbait(rows):
    """rows: key, postText, mean (0 to 1): already joined with their truth by id."""
    return rows.select(*example(F.col("key"), "clickbait", stripped(F.col("postText")), [score("clickbait", "How much of a clickbait is this post?", 0, 1)], {"clickbait": answer(value=F.col("mean"))}, ["heldout", "score"]))


@converter
def poems(rows, names: list[str]):
    asked = choice("sentiment", "What is the sentiment of this verse?", _labels(names))
    return rows.where(_at(names, F.col("label")).isNotNull()).select(*example(F.col("key"), "poem_sentiment", stripped(F.col("verse")), [asked], {"sentiment": answer(_at(names, F.col("label")))}, ["heldout"]))


def with_truth(instances: DataFrame, truth: DataFrame, key: str = "id") -> DataFrame:
    """Instances beside their truth, those that have one."""
    return instances.join(truth, key)


def per_hypothesis(documents: DataFrame, hypotheses: DataFrame) -> DataFrame:
    """documents: key, text, annotations map (hypothesis id to (choice, spans)); hypotheses: hid, hyp, a short table."""
    rows = documents.select("key", "text", F.explode("annotations").alias("hid", "a"))
    return rows.join(F.broadcast(hypotheses), "hid").select(F.concat_ws(":", "key", "hid").alias("key"), "text", "hyp", F.col("a.choice").alias("choice"))
