"""Text scoring and extraction with rule tables (#59-#60g, re-aimed).

The reference asks a language model for these; here each is a deterministic job
with the same output schema.  A rule table is a fixed, small mapping
``label -> terms`` (unit weights), so it is compiled into the expression itself:
each message scores every label from its own token array (``filter`` +
``array_contains``), in place.  No explode, no join, no shuffle - a map-only
projection that stays in codegen.  Context that spans messages (history,
per-session TF-IDF) uses bounded window frames and aggregates keyed by session.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.operators import catalog, matching
from parlance.operators.retrieval import tokens, with_frequencies
from parlance.session import stored

# Fixed values (our rule tables; the prompts name the labels but give no terms).
INTENT_RULES = {
    "purchase_consultation": ["buy", "order", "purchase", "price", "cost", "mua", "giá", "acheter", "kaufen", "comprar"],
    "product_inquiry": ["what", "which", "size", "color", "model", "product", "quel", "welche", "cual", "sản"],
    "complaint": ["bad", "broken", "wrong", "refund", "not", "pas", "nicht", "no", "problem", "problème"],
    "support_request": ["help", "error", "fix", "issue", "support", "aide", "hilfe", "ayuda"],
    "information_request": ["how", "when", "where", "info", "information", "comment", "wie", "como"],
    "booking": ["book", "reserve", "appointment", "schedule", "réserver", "buchen", "reservar"],
    "cancellation": ["cancel", "stop", "annuler", "stornieren", "cancelar"],
    "feedback": ["thanks", "great", "good", "love", "merci", "danke", "gracias", "bien"],
}
EMOTION_RULES = {
    "frustration": ["again", "still", "waiting", "why", "encore", "immer", "todavía", "nicht"],
    "anger": ["angry", "terrible", "worst", "furious", "hate", "nul", "schlecht", "malo"],
    "sadness": ["sad", "sorry", "unfortunately", "triste", "leider", "lamentablemente"],
    "joy": ["happy", "great", "love", "thanks", "merci", "danke", "gracias", "bien"],
    "fear": ["afraid", "worried", "risk", "peur", "angst", "miedo"],
}
FLAG_RULES = {
    "legal": ["lawyer", "law", "court", "legal", "avocat", "anwalt", "abogado"],
    "medical": ["doctor", "medical", "hospital", "health", "médecin", "arzt", "médico"],
    "financial_risk": ["loan", "debt", "credit", "fraud", "bank", "banque"],
    "high_technical": ["api", "server", "bug", "crash", "install", "config"],
}
REQUIREMENT_TERMS = ["size", "color", "price", "delivery", "warranty", "material", "style", "quality",
                     "taille", "couleur", "prix", "größe", "farbe", "preis", "talla", "precio"]
# implied requirement -> trigger terms
IMPLIED_RULES = {
    "budget": ["price", "prix", "preis", "precio", "cheap"],
    "fit": ["size", "taille", "größe", "talla"],
    "durability": ["quality", "material", "warranty"],
}
SERVICE_RULES = {
    "consultation": ["what", "which", "recommend", "quel", "welche"],
    "purchase": ["buy", "order", "kaufen", "acheter", "comprar"],
    "support": ["help", "error", "fix", "aide", "hilfe"],
    "complaint": ["bad", "broken", "refund", "problem"],
    "booking": ["book", "reserve", "buchen", "réserver"],
    "information": ["how", "when", "where", "info", "wie", "como"],
}
STAGE_RULES = {
    "greeting": ["hello", "hi", "bonjour", "hallo", "hola", "xin", "chào"],
    "need_discovery": ["need", "want", "looking", "besoin", "brauche", "necesito"],
    "solution_matching": ["recommend", "suggest", "option", "match", "propose"],
    "price_discussion": ["price", "cost", "discount", "prix", "preis", "precio"],
    "objection_handling": ["but", "however", "mais", "aber", "pero", "expensive"],
    "closing": ["buy", "order", "confirm", "deal", "commande", "bestellen"],
}
INTEREST_TERMS = ["music", "sport", "travel", "books", "food", "fashion", "musique", "reise", "viaje"]
BANNED_PHRASES = ["miễn phí", "guaranteed", "cam kết 100%"]
EMAIL_RE = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
# a national number of ten digits, plain or grouped; or a grouped international one
PHONE_RE = (r"(?:\+84|0)(?:[ .-]?[0-9]){9}\b|"
            r"\+?[0-9]{1,3} ?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-][0-9]{4}")
# an amount with its currency; other numbers in a text (counts, sizes) are no prices
PRICE_RE = r"(?i)([0-9]+(?:[.,][0-9]+)*) ?(?:đ|₫|vnđ|vnd)"
NAME_RE = r"(?i)my name is ([\p{L}]+)"
EMOTION_STEP = 0.25     # score per hit, clipped to 1.0
FALLBACK_INTENT = "unknown"
FALLBACK_CONFIDENCE = 0.5


def hits(toks: Column, terms) -> Column:
    """Number of tokens that are rule terms (counted with multiplicity)."""
    lit = F.array(*[F.lit(t) for t in terms])
    return F.size(F.filter(toks, lambda t: F.array_contains(lit, t)))


def label_scores(toks: Column, rules: dict) -> dict[str, Column]:
    return {label: hits(toks, terms) for label, terms in rules.items()}


def _most(columns) -> Column:
    """The largest of one or more columns."""
    columns = list(columns)
    return F.greatest(*columns) if len(columns) > 1 else columns[0]


def arg_max_label(scores: dict[str, Column], fallback: str) -> tuple[Column, Column]:
    """(label, winner share); ties go to the earlier label; no hits -> fallback."""
    top = _most(scores.values())
    total = sum(scores.values(), F.lit(0))
    label = None
    for name, s in scores.items():
        label = F.when(s == top, F.lit(name)) if label is None else label.when(s == top, F.lit(name))
    label = F.when(top > 0, label.otherwise(F.lit(fallback))).otherwise(F.lit(fallback))
    share = F.when(top > 0, F.round(top / total, 6))
    return label, share


def intent_scores(turns: DataFrame, text_col: str = "text", rules: dict = INTENT_RULES) -> DataFrame:
    """#59: intent code (8 codes or ``unknown``) and confidence = winner share (0.5 when no hit)."""
    toks = tokens(F.col(text_col))
    label, share = arg_max_label(label_scores(toks, rules), FALLBACK_INTENT)
    return turns.withColumn("intent_code", label).withColumn(
        "confidence", F.coalesce(share, F.lit(FALLBACK_CONFIDENCE)))


def emotion_policy_scores(turns: DataFrame, text_col: str = "text", emotions: dict = EMOTION_RULES,
                          flags: dict = FLAG_RULES) -> DataFrame:
    """#60: 5 emotions clipped to 0..1, neutral = 1 - max, 4 policy flags, risk level."""
    toks = tokens(F.col(text_col))
    d = turns
    for name, s in label_scores(toks, emotions).items():
        d = d.withColumn(name, F.least(F.lit(1.0), s * EMOTION_STEP).cast("double"))
    d = d.withColumn("neutral", 1.0 - _most(F.col(n) for n in emotions))
    for name, s in label_scores(toks, flags).items():
        d = d.withColumn(name, s > 0)
    neg = F.greatest(F.col("frustration"), F.col("anger"))
    any_flag = _most(F.col(f).cast("int") for f in flags) == 1
    return d.withColumn("risk_level", F.when(neg > 0.7, "high").when((neg > 0.4) | any_flag, "medium")
                        .otherwise("low"))


def requirement_terms(messages: DataFrame, history: int = 20, ttl: int | None = None) -> DataFrame:
    """#60b: explicit terms (latest message), implicit terms (history-only hits + implied), service type.

    History is the previous ``history - 1`` messages of the short memory (the same
    hot-session-safe bounded frame as #36), so a long session never gathers more
    than that per row.  A message's terms are the bits of one number, so that a frame is
    an ``OR`` of numbers; no token list and no text goes through the windows.
    """
    from parlance.operators.memory import TTL_SECONDS, rolling_frame

    bit = {t: F.lit(1 << i).cast("long") for i, t in enumerate(REQUIREMENT_TERMS)}
    kept = lambda terms: F.filter("_toks", lambda t: t.isin(*terms))
    has = lambda bits, terms: bits.bitwiseAND(sum(1 << REQUIREMENT_TERMS.index(t) for t in terms)) != 0
    d = messages.withColumn("_toks", tokens(F.col("content")))
    # what several expressions read is computed once, in its own projection
    d = d.select("*", kept(REQUIREMENT_TERMS).alias("_hit"), kept(sum(SERVICE_RULES.values(), [])).alias("_served"))
    d = d.select("*", *[n.alias(f"_n{i}") for i, n in enumerate(label_scores(F.col("_served"), SERVICE_RULES).values())])
    service, _ = arg_max_label({label: F.col(f"_n{i}") for i, label in enumerate(SERVICE_RULES)}, "information")
    said = sum((F.when(F.array_contains("_hit", t), b).otherwise(F.lit(0).cast("long")) for t, b in bit.items()),
               F.lit(0).cast("long"))
    d = d.withColumn("service_type", service).withColumn("_said", said).drop(
        "_toks", "_hit", "_served", *[f"_n{i}" for i in range(len(SERVICE_RULES))])
    d = rolling_frame(d, ["_said"], history, ttl or TTL_SECONDS, out_col="_seen", gather=F.bit_or("_said")).drop("seg_no")
    own, seen = F.col("_said"), F.col("_seen")
    explicit = F.array_compact(F.array(*[F.when(has(own, [t]), F.lit(t)) for t in sorted(REQUIREMENT_TERMS)]))
    earlier = seen.bitwiseAND(F.bitwise_not(own))
    implied = {t: has(earlier, [t]) for t in REQUIREMENT_TERMS}
    for name, trig in IMPLIED_RULES.items():
        implied[name] = implied.get(name, F.lit(False)) | has(seen, [t for t in trig if t in bit])
    implicit = F.array_compact(F.array(*[F.when(implied[t], F.lit(t)) for t in sorted(implied)]))
    return (d.withColumn("explicit_requirements", explicit).withColumn("implicit_requirements", implicit)
            .select(*messages.columns, "explicit_requirements", "implicit_requirements", "service_type"))


def stage_classification(messages: DataFrame, allowed_stages: list[str], successor: dict) -> DataFrame:
    """#60c: current node = best-scoring stage among the shop's stages; next nodes = stay or successor."""
    toks = tokens(F.col("content"))
    rules = {k: v for k, v in STAGE_RULES.items() if k in allowed_stages}
    node, conf = arg_max_label(label_scores(toks, rules), allowed_stages[0])
    nxt = F.create_map(*[x for k, v in successor.items() for x in (F.lit(k), F.lit(v))])
    return (messages.withColumn("current_sales_node", node)
            .withColumn("allowed_next_nodes", F.array_compact(F.array(F.col("current_sales_node"),
                                                                      F.element_at(nxt, F.col("current_sales_node")))))
            .withColumn("confidence", F.coalesce(conf, F.lit(FALLBACK_CONFIDENCE))))


def shop_stage_classification(messages: DataFrame, stages: DataFrame) -> DataFrame:
    """#60c by each shop's own pipeline: the best-scoring of the shop's stages (ties and no hit: the earlier one), the
    nodes that may follow, and the winner's share of the hits.

    ``messages``: ``shop_id, content``; ``stages``: ``shop_id, step_order, stage_name``.  A stage without rule terms
    scores 0.  A pipeline is one row per shop, written, so that messages meet a table of known size; a shop
    without stages gives nulls."""
    steps = F.array_sort(F.collect_list(F.struct("step_order", "stage_name")))
    pipelines = stored(stages.groupBy("shop_id").agg(F.transform(steps, lambda x: x["stage_name"]).alias("_stages")), "pipelines")
    j = messages.join(pipelines, "shop_id", "left").withColumn("_toks", tokens(F.col("content")))
    hits_of = F.create_map(*[x for label, n in label_scores(F.col("_toks"), STAGE_RULES).items() for x in (F.lit(label), n)])
    j = j.withColumn("_hits", hits_of)
    scored = F.transform("_stages", lambda name, i: F.struct(
        F.coalesce(F.element_at(F.col("_hits"), name), F.lit(0)).alias("n"), (-i).alias("place")))
    j = j.withColumn("_scored", scored).withColumn("_best", F.array_max("_scored"))
    at = F.when(F.col("_best.n") > 0, -F.col("_best.place")).otherwise(0)
    total = F.aggregate("_scored", F.lit(0), lambda s, x: s + x["n"])
    return (j.withColumn("current_sales_node", F.get("_stages", at))
            .withColumn("allowed_next_nodes", F.when(F.col("_stages").isNotNull(), F.slice("_stages", at + 1, 2)))
            .withColumn("confidence", F.when(F.col("_best.n") > 0, F.round(F.col("_best.n") / total, 6))
                        .when(F.col("_stages").isNotNull(), F.lit(FALLBACK_CONFIDENCE)))
            .drop("_stages", "_toks", "_hits", "_scored", "_best"))


def combo_ranking(questions: DataFrame, candidates: DataFrame, text_col: str = "text",
                  extra_cols: tuple = ()) -> DataFrame:
    """#60d: best in-stock combo: explicit name hit, then word hits, then stock, then catalog order.

    Names meet texts as in the catalog matching, and words inside tasks (``matching.best_overlap``); of
    equal names in a shop the one with most stock stands for all.  ``extra_cols`` are lists
    of requirement texts that count as part of the message.  No hit -> null.
    """
    pieces = [F.coalesce(F.col(text_col), F.lit("")), *(F.array_join(F.coalesce(F.col(c), F.array().cast("array<string>")), " ")
                                                        for c in extra_cols)]
    q = questions.withColumn("_hay", F.lower(F.concat_ws(" ", *pieces)))
    hays = stored(q.select("shop_id", "_hay").distinct(), "ranked-texts")
    names = catalog._names(candidates.where(F.col("stock") > 0))
    words = lambda c: F.array_distinct(c).alias("words")
    best = stored(names.groupBy("shop_id", "token").agg(F.min(F.struct(
        (-F.col("stock")).alias("less"), "rank", "combo_id")).alias("best"))
        .select("shop_id", "token", "best", words(F.split("token", " "))), "ranked-names")
    texts = hays.select("shop_id", "_hay", words(tokens(F.col("_hay"))))
    hits = stored(matching.name_hits(hays, best), "name-hits")
    explicit = (hits.join(best, ["shop_id", "token"]).join(texts.withColumnRenamed("words", "said"), ["shop_id", "_hay"])
                .groupBy("shop_id", "_hay").agg(F.min(F.struct(
                    (-F.size(F.array_intersect("words", "said"))).alias("less"), "best")).alias("top"))
                .select("shop_id", "_hay", F.col("top.best.combo_id").alias("best_combo")))
    # words only decide where no name is said
    others = texts.join(hits.select("shop_id", "_hay"), ["shop_id", "_hay"], "left_anti")
    implicit = matching.best_overlap(others, best).select("shop_id", "_hay", F.col("best.combo_id").alias("best_combo"))
    found = stored(explicit.unionByName(implicit), "ranked-matches")
    return q.join(found, ["shop_id", "_hay"], "left").drop("_hay")


def plain_number(x: Column) -> Column:
    """An amount as written (``199.000``, ``1,234.50``, ``901.00``) in plain notation:
    separators before groups of three digits are dropped, a last other one is the point."""
    grouped = F.regexp_replace(x, r"[.,](?=[0-9]{3}(?:[.,]|$))", "")
    return F.regexp_replace(grouped, ",", ".")


def response_claim_check(responses: DataFrame) -> DataFrame:
    """#60e: approve, double-check or reject a response from its claims.

    ``responses`` has ``response``, ``catalog_price`` (decimal) and ``stock``.
    Banned phrase -> rejected; any quoted price != catalog price or stock 0 offered ->
    approved with a double-check flag and reason; else approved.
    """
    low = F.lower(F.col("response"))
    banned = F.lit(False)
    for phrase in BANNED_PHRASES:
        banned = banned | (F.instr(low, phrase) > 0)
    quoted = F.transform(F.regexp_extract_all("response", F.lit(PRICE_RE), 1), lambda x: plain_number(x).cast("decimal(14,2)"))
    mismatch = F.exists(quoted, lambda x: x != F.col("catalog_price"))
    reason = (F.when(banned, F.lit("banned phrase"))
              .when(F.coalesce(mismatch, F.lit(False)), F.lit("price mismatch"))
              .when(F.col("stock") <= 0, F.lit("out of stock offered")))
    return (responses.withColumn("approved", ~banned)
            .withColumn("sales_doublecheck", reason.isNotNull() & ~banned)
            .withColumn("reason_recheck", reason))


def user_info_extract(messages: DataFrame, session_col: str, order_cols, text_col: str = "text") -> DataFrame:
    """#60f: e-mail, phone, name ("my name is X") and interests, last non-null per session.

    Extraction is per message (regex in place); the per-session reduction is a
    ``max_by`` aggregate (partial, map-side), so a hot session costs one row per task.
    """
    t = F.col(text_col)
    vocab = F.array(*[F.lit(x) for x in INTEREST_TERMS])
    d = messages.select(
        session_col, *order_cols,
        F.nullif(F.regexp_extract(t, EMAIL_RE, 0), F.lit("")).alias("email"),
        F.nullif(F.regexp_extract(t, PHONE_RE, 0), F.lit("")).alias("phone"),
        F.nullif(F.regexp_extract(t, NAME_RE, 1), F.lit("")).alias("name"),
        F.array_distinct(F.filter(tokens(t), lambda x: F.array_contains(vocab, x))).alias("_int"))
    o = F.struct(*order_cols)
    return d.groupBy(session_col).agg(
        *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), o)).alias(c) for c in ("name", "phone", "email")],
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("_int")))).alias("interests"))


def conversation_topics(messages: DataFrame, top_terms: int = 5, top_sentences: int = 2) -> DataFrame:
    """#60g: tags = top TF-IDF terms per session; summary = its best sentences in text order.

    tf per (session, term) is one aggregate; df per term another; idf uses the
    session count (one scalar).  Ranking keeps ``top_terms`` per session with
    ``row_number`` (WindowGroupLimit).  Sentences score the sum of their tokens'
    TF-IDF; the best ``top_sentences`` per session are kept the same way.
    """
    toks = messages.select("session_id", F.explode(tokens(F.col("content"))).alias("term"))
    tf = stored(toks.groupBy("session_id", "term").agg(F.count(F.lit(1)).alias("tf")), "session-terms")
    n = messages.select("session_id").distinct().count()
    dfreq = stored(tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "session-frequencies")
    tfidf = stored(with_frequencies(tf, dfreq).select("session_id", "term", F.round(
        F.col("tf") * F.log(F.lit(float(n)) / F.col("df")), 9).alias("tfidf")), "session-weights")
    w = Window.partitionBy("session_id").orderBy(F.col("tfidf").desc(), F.col("term"))
    tags = (tfidf.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= top_terms)
            .groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("_r", "term"))).alias("_t"))
            .select("session_id", F.transform("_t", lambda x: x["term"]).alias("tags")))
    sents = messages.select("session_id", "msg_id", "ts",
                            F.posexplode(F.regexp_extract_all(F.col("content"), F.lit(r"[^.!?]+[.!?]*"), 0))
                            .alias("spos", "sentence"))
    sents = sents.withColumn("sentence", F.regexp_replace("sentence", r"^\s+|\s+$", "")).where(
        F.length("sentence") > 0)
    # a sentence's words carry its number, not its text
    sents = stored(sents.withColumn("_sentence", F.monotonically_increasing_id()), "sentences")
    words = sents.select("session_id", "_sentence", F.explode(tokens(F.col("sentence"))).alias("term"))
    scored = (words.join(tfidf, ["session_id", "term"]).groupBy("_sentence").agg(F.sum("tfidf").alias("score")))
    sscore = sents.join(scored, "_sentence").groupBy("session_id", "msg_id", "ts", "spos", "sentence").agg(
        F.round(F.sum("score"), 6).alias("score"))
    ws = Window.partitionBy("session_id").orderBy(F.col("score").desc(), "ts", "msg_id", "spos")
    best = (sscore.withColumn("_r", F.row_number().over(ws)).where(F.col("_r") <= top_sentences)
            .groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("ts", "msg_id", "spos", "sentence")))
                                       .alias("_s"))
            .select("session_id", F.array_join(F.transform("_s", lambda x: x["sentence"]), " ").alias("summary")))
    return tags.join(best, "session_id", "left")
