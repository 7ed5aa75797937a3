"""Problem 7: linking the spellings of a name that mean the same person or organisation.

Method: noisy-channel attribution.  A spelling is parsed into a surname and given names (or an
organisation's words).  Frequent plain spellings are the candidate canonical forms; a candidate's prior is its
share of works, and a spelling's likelihood under a candidate is the product of what happened to its parts: a
given name kept, shortened to its usual nickname or initial, a typing slip in either part.  Every spelling
is attached to the candidate of largest posterior; spellings of one candidate are linked.

Everything that looks across rows is a Spark aggregation or equi-join: spellings collapse first, then
surnames and given names are corrected through deletion keys (two words within one slip share a key), then
spellings meet only candidates with their own surname.  A hot author is one row after the first aggregation.

Defined results: null, blank and placeholder names mean nobody and are never linked; a spelling without a
candidate stands alone; strings are compared exactly as stored (blanks and case included); every unordered
pair of an entity's spellings comes out once; an empty table gives no pairs.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import cut, texts_of

#: Names that mean nobody in particular, folded.
PLACEHOLDERS = frozenset(
    (
        "anon", "anonymous", "unknown", "various", "n a", "na", "none", "null", "nil", "author", "authors", "unknown author", "author unknown",
        "unnamed", "untitled", "staff", "admin", "editor", "editors", "the editor", "the editors", "various authors", "various hands",
        "several hands", "many hands", "no author", "not known", "not stated", "not given", "anonymous author", "guest", "user", "collective",
        "multiple authors", "several authors", "authors various", "multiple", "nn", "n n", "nobody", "name withheld", "tba", "tbd", "et al", "the author", "author s", "misc",
    )
)
#: Usual English short forms of given names and what they stand for.
NICKNAMES = {
    "abby": "abigail", "abbie": "abigail", "gail": "abigail", "alec": "alexander", "sandy": "alexander", "xander": "alexander", "lex": "alexander alexandra", "tony": "anthony", "gus": "augustine augustus angus",
    "ed": "edwin edward edmund edgar", "eddie": "edwin edward edmund edgar", "ned": "edwin edward edmund", "ted": "theodore edward edmund", "teddy": "theodore edward", "ellie": "eleanor ellen elizabeth", "nell": "eleanor ellen helen", "nellie": "eleanor ellen helen", "nora": "eleanor honora",
    "flossie": "florence", "florrie": "florence", "fanny": "frances", "frankie": "frances francis franklin", "frank": "francis franklin", "fred": "frederick alfred", "freddie": "frederick alfred winifred", "freddy": "frederick alfred",
    "kate": "katherine catherine", "kathy": "katherine catherine kathleen", "katie": "katherine catherine", "kit": "katherine christopher", "kitty": "katherine catherine", "cathy": "catherine", "meg": "margaret", "maggie": "margaret", "peggy": "margaret", "peg": "margaret", "madge": "margaret", "greta": "margaret", "rita": "margaret",
    "tilda": "matilda", "tilly": "matilda", "tillie": "matilda", "maud": "matilda", "mattie": "matilda martha", "mike": "michael", "mick": "michael", "mickey": "michael", "tom": "thomas", "tommy": "thomas", "mina": "wilhelmina", "minnie": "wilhelmina minerva", "billie": "wilhelmina", "willa": "wilhelmina",
    "bill": "william", "billy": "william", "liam": "william", "wally": "walter wallace", "wat": "walter", "dell": "wendell", "freda": "winifred", "bob": "robert", "rob": "robert", "bobby": "robert", "bert": "robert albert herbert", "dick": "richard", "rick": "richard frederick", "ricky": "richard", "jim": "james", "jimmy": "james", "jamie": "james",
    "jack": "john jackson", "johnny": "john", "joe": "joseph", "liz": "elizabeth", "lizzie": "elizabeth", "beth": "elizabeth bethany", "betty": "elizabeth", "bess": "elizabeth", "bessie": "elizabeth", "betsy": "elizabeth", "libby": "elizabeth", "eliza": "elizabeth", "dave": "david", "davy": "david", "harry": "henry harold harrison", "hank": "henry", "hal": "henry harold",
    "topher": "christopher", "chris": "christopher christina christine", "kris": "kristina kristopher", "tina": "christina martina", "nick": "nicholas", "nicky": "nicholas nicola", "steve": "stephen steven", "sue": "susan susanna susannah suzanne", "becky": "rebecca", "becca": "rebecca", "chuck": "charles", "charlie": "charles charlotte", "lottie": "charlotte", "carrie": "caroline", "larry": "lawrence",
    "tori": "victoria", "vicky": "victoria", "dot": "dorothy", "dotty": "dorothy", "dolly": "dorothy", "archie": "archibald", "bertie": "albert herbert", "ernie": "ernest", "geoff": "geoffrey", "jeff": "jeffrey", "jon": "jonathan", "jonny": "jonathan", "jo": "josephine joanna joanne", "josie": "josephine", "pip": "philip philippa", "phil": "philip philippa",
    "sam": "samuel samantha", "sammy": "samuel samantha", "gabe": "gabriel", "gerry": "gerald gerard geraldine", "jerry": "gerald jeremiah jerome", "roddy": "roderick rodney", "lily": "lillian", "lil": "lillian", "patsy": "patricia", "pat": "patricia patrick", "patty": "patricia", "paddy": "patrick", "deb": "deborah", "debbie": "deborah", "jen": "jennifer", "jenny": "jennifer jane",
    "penny": "penelope", "polly": "mary paula", "molly": "mary", "sally": "sarah", "sadie": "sarah", "nan": "anne nancy", "annie": "anne anna", "nancy": "anne", "hattie": "harriet", "hetty": "henrietta harriet", "trudy": "gertrude", "gertie": "gertrude", "milly": "mildred millicent", "effie": "euphemia", "reg": "reginald", "ron": "ronald", "ray": "raymond", "vin": "vincent", "vince": "vincent", "zach": "zachary",
    "alex": "alexander alexandra", "dan": "daniel", "danny": "daniel", "susie": "susan susanna susannah suzanne", "will": "william", "willie": "william", "theo": "theodore", "wen": "wendell", "win": "winifred winston", "winnie": "winifred", "flo": "florence", "fran": "frances francesca", "kim": "kimberley", "tabby": "tabitha", "walt": "walter",
    "matt": "matthew", "andy": "andrew", "drew": "andrew", "ben": "benjamin", "benny": "benjamin", "tim": "timothy", "greg": "gregory", "josh": "joshua", "nate": "nathaniel nathan", "cal": "calvin", "clem": "clement clementine", "con": "constance cornelius", "connie": "constance", "di": "diana", "don": "donald", "doug": "douglas", "gwen": "gwendolen gwendoline", "ken": "kenneth", "les": "leslie lester",
    "mandy": "amanda", "marge": "margaret marjorie", "max": "maximilian maxwell", "mel": "melanie melvin", "norm": "norman", "ollie": "oliver olive", "stan": "stanley",
}
#: Words of organisations and their usual short forms.
ORGANISATION = {
    "press": "press", "pr": "press", "collective": "collective", "coll": "collective", "publishing": "publishing", "publ": "publishing", "pub": "publishing", "publishers": "publishing",
    "company": "company", "co": "company", "literary": "literary", "lit": "literary", "association": "association", "assoc": "association", "assn": "association", "ass": "association",
    "writers": "writers", "wr": "writers", "circle": "circle", "circ": "circle", "society": "society", "soc": "society", "group": "group", "grp": "group", "club": "club",
    "house": "house", "guild": "guild", "institute": "institute", "inst": "institute", "foundation": "foundation", "fdn": "foundation", "books": "books", "union": "union",
    "library": "library", "libr": "library", "league": "league", "workshop": "workshop", "authors": "authors", "poets": "poets", "poetry": "poetry", "readers": "readers", "university": "university", "univ": "university",
    "editions": "editions", "eds": "editions", "ltd": "limited", "limited": "limited", "inc": "incorporated", "incorporated": "incorporated", "department": "department", "dept": "department", "committee": "committee", "comm": "committee",
}
_TITLES = frozenset("dr mr mrs ms miss prof professor sir dame rev reverend fr lady lord capt captain".split())
_SUFFIXES = frozenset("jr sr esq phd md ii iii".split())
_AUTHOR = re.compile(r"\((?:the )?(?:author|ed|editor|writer|auth)\.?\)|\b(?:author|writer)$")
_BY = re.compile(r"^(?:written |story |text )?by[:\s]+")
#: Odds against a word being typed with one slip, for surnames and given names: a word goes over to a neighbour within
#: one slip whose prior (works) is more than so many times its own, which is where the posterior turns.
SURNAME_ODDS, GIVEN_ODDS, HEAD_ODDS = 1.5, 6.0, 1.0
#: Log odds of a candidate whose known middle initials hold the variant's, or hold others only.
MIDDLE_SAME, MIDDLE_OTHER = 3.0, -1.0
#: A short form is learned from at least so many surnames, and so large a share of its own.
LEARNED_FROM, LEARNED_SHARE = 4, 0.5
PARSED = "org boolean, surname string, given string, initial string, middle string, plain boolean, alt_surname string, alt_given string"


def folded(text: str) -> str:
    t = unicodedata.normalize("NFKD", text)
    t = "".join(c for c in t if not unicodedata.combining(c) and unicodedata.category(c) != "Cf").casefold()
    return t.replace("’", "'").replace("ø", "o").replace("ł", "l").replace("æ", "ae").strip()


def placeholder(text: str | None) -> bool:
    words = " ".join(re.findall(r"[^\W_]+", folded(text or "")))
    return not words or words in PLACEHOLDERS or not re.search(r"[^\W\d_]{2}", words)


def parse(text: str) -> dict | None:
    """The parts of a name.  ``alt_``: the reading with the parts swapped, where the order isn't known."""
    if placeholder(text):
        return None
    upper_pair = re.match(r"^\s*(?:by\s+)?([A-Z])\.?\s?([A-Z])\.?\s+[^\W\d_]{3,}", text)
    t = _BY.sub("", _AUTHOR.sub("", folded(text)).strip()).strip()
    bare = [w for w in re.findall(r"[^\W_]+", t.replace("'", "")) if w not in ("the",)]
    org = [ORGANISATION.get(w) for w in bare]
    if len(bare) >= 2 and any(org[1:]) and (bare[0] not in _TITLES) and not (len(bare) == 2 and "," in t):
        head = [w for w, o in zip(bare, org, strict=True) if o is None]
        kind = [o for o in org if o]
        return {"org": True, "surname": " ".join(head), "given": " ".join(kind), "initial": "", "middle": "", "plain": t.startswith("the ") and "." not in t, "alt_surname": None, "alt_given": None}
    inverted = t.count(",") == 1 and all(x.strip() for x in t.split(",")) and t.split(",")[1].strip().strip(".") not in _SUFFIXES
    if inverted:
        last, first = t.split(",")
        words = re.findall(r"[^\W_]+", first.replace("'", "")) + ["|"] + re.findall(r"[^\W_]+", last.replace("'", ""))
        words = [w for w in words if w not in _TITLES and w not in _SUFFIXES]
        at = words.index("|")
        first_words, last_words = words[:at], words[at + 1 :]
    else:
        words = re.findall(r"[^\W_]+", t.replace("'", ""))
        initials = upper_pair and len(words) == 2 and not text.isupper()  # "MR Zelkisampe": no title
        words = [w for i, w in enumerate(words) if (initials and i == 0) or (w not in _TITLES and w not in _SUFFIXES)]
        if len(words) < 2:
            return {"org": False, "surname": words[0] if words else "", "given": "", "initial": "", "middle": "", "plain": False, "alt_surname": None, "alt_given": None} if words else None
        if len(words[-1]) == 1 and len(words[0]) > 1:  # "Fenkachotte E J"
            last_words, first_words = words[:1], words[1:]
        else:
            last_words, first_words = words[-1:], words[:-1]
    if not last_words or not first_words:
        return None
    if len(first_words) == 1 and len(first_words[0]) == 2 and upper_pair and first_words[0] not in NICKNAMES:  # "KT Mermopiman"
        first_words = list(first_words[0])
    given = first_words[0]
    full = len(given) > 1
    swap = not inverted and len(words) == 2 and len(words[0]) > 2 and words[0] not in NICKNAMES
    return {
        "org": False, "surname": last_words[-1], "given": given if full else "", "initial": given[0], "middle": first_words[1][0] if len(first_words) > 1 else "",
        "plain": full and not inverted and len(first_words) == 1 and first_words[0] not in NICKNAMES,
        "alt_surname": words[0] if swap else None, "alt_given": words[-1] if swap else None,
    }


def one_slip(a: str, b: str) -> bool:
    """True if the words differ by at most one insertion, deletion, substitution or swap of neighbours."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])
    return a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :]


def _corrections(words: DataFrame, ratio: float, shortest: int) -> DataFrame:
    """(word, n) -> (word, right): the much more frequent word within one slip, if any, else the word itself.

    Two words within one slip share the word itself or a word with one letter taken out.
    """
    keys = "array_distinct(concat(array(word), transform(sequence(1, length(word)), i -> concat(substring(word, 1, i - 1), substring(word, i + 1)))))"
    long = words.where(F.length("word") >= shortest)
    keyed = long.select("word", "n", F.explode(F.expr(keys)).alias("key"))
    # A key is shared only by words one letter apart, so it joins few rows however often the words occur.
    near = (
        keyed.alias("a")
        .join(keyed.alias("b"), F.expr("a.key = b.key and a.word <> b.word"))
        .where(F.expr(f"b.n >= {ratio} * a.n"))
        .select(F.expr("a.word word"), F.expr("b.word other"), F.expr("b.n n"))
        .distinct()
        # sharing a key also holds for some pairs two slips apart
        .where(F.expr("levenshtein(word, other) <= 1 or (length(word) = length(other) and levenshtein(word, other) = 2)"))
    )

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            keep = [one_slip(x, y) for x, y in zip(texts_of(b, 0), texts_of(b, 1), strict=True)]
            yield b.filter(pa.array(keep, pa.bool_()))

    checked = near.mapInArrow(run, near.schema)
    best = checked.groupBy("word").agg(F.max(F.struct("n", "other")).alias("m")).select("word", F.col("m.other").alias("right"))
    return words.select("word").join(best, "word", "left").select("word", F.coalesce("right", "word").alias("right"))


def attribute(stories: DataFrame, author_col: str = "author", work_col: str = "group_id") -> DataFrame:
    """(author, entity): each spelling with the canonical form it is attached to.

    ``entity`` is the candidate's surname and given name (an organisation's words), or the spelling's own parts
    where nothing better is known.
    """
    # Parts of one work carry one typed name, so works are counted, not rows.
    typed = stories.select(F.col(author_col).alias("author"), F.col(work_col).alias("w")).where("author is not null").distinct().groupBy("author").agg(F.count("*").alias("n"))

    def run(batches: Iterator[pa.RecordBatch]):
        names = [x.split(" ")[0] for x in PARSED.split(", ")]
        kinds = [pa.bool_() if x.endswith("boolean") else pa.string() for x in PARSED.split(", ")]
        for b in batches:
            got = [parse(a) for a in texts_of(b, 0)]
            keep = pa.array([g is not None for g in got], pa.bool_())
            got = [g for g in got if g]
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep), *(pa.array([g[k] for g in got], t) for k, t in zip(names, kinds, strict=True))], names=["author", "n", *names])

    parsed = cut(typed.mapInArrow(run, f"author string, n bigint, {PARSED}"))
    person = parsed.where("not org")

    # Reading order: turned round where the turned form has the larger prior as a plain spelling, or the last word is
    # the one that stands before many surnames.
    plain = person.where("plain")
    given_use = plain.groupBy("given").agg(F.countDistinct("surname").alias("n_given"))
    forms = plain.groupBy("given", "surname").agg(F.sum("n").alias("n_form"))
    as_alt = {"given": "alt_given", "surname": "alt_surname", "n_given": "n_alt", "n_form": "n_alt_form"}
    person = (
        person.join(given_use, "given", "left")
        .join(forms, ["given", "surname"], "left")
        .join(given_use.withColumnsRenamed(as_alt), "alt_given", "left")
        .join(forms.withColumnsRenamed(as_alt), ["alt_given", "alt_surname"], "left")
        .withColumn("swap", F.expr("alt_given is not null and (coalesce(n_alt_form, 0) > coalesce(n_form, 0) or (n_alt_form is null and coalesce(n_alt, 0) > 5 * coalesce(n_given, 0)))"))
        .withColumn("right_surname", F.expr("if(swap, alt_surname, surname)"))
        .withColumn("right_given", F.expr("if(swap, alt_given, given)"))
        .selectExpr("author", "n", "right_surname surname", "right_given given", "if(swap, substring(alt_given, 1, 1), initial) initial", "middle", "plain and not swap plain")
    )
    person = cut(person)
    given_n = person.where("given <> ''").groupBy(F.col("given").alias("word")).agg(F.sum("n").alias("n"))
    given_fix = _corrections(given_n, GIVEN_ODDS, 4)
    surname_n = person.groupBy(F.col("surname").alias("word")).agg(F.sum("n").alias("n"))
    surname_fix = _corrections(surname_n, SURNAME_ODDS, 5)
    right = (
        person.join(surname_fix.select(F.col("word").alias("surname"), F.col("right").alias("s")), "surname")
        .join(given_fix.select(F.col("word").alias("given"), F.col("right").alias("g")), "given", "left")
        .withColumn("g", F.coalesce("g", F.lit("")))
        .select("author", "n", "s", "g", "initial", "middle")
    )
    # Each stage is a few distinct spellings: written once, so that plans stay small however often they are used.
    right = cut(right)
    # Candidates: full forms; the prior is the number of works under that form, plain spellings first.
    candidates = cut(right.where("g <> ''").groupBy("s", "g").agg(F.sum("n").alias("prior")))
    # Short forms of given names: the usual ones, and those that the corpus shows (a name whose surnames mostly also come
    # with one more frequent name).  They go over to a candidate of the same surname, the one of largest prior.
    spark = stories.sparkSession
    usual = spark.createDataFrame([(short, long) for short, longs in NICKNAMES.items() for long in longs.split()], "g string, formal string")
    works = candidates.groupBy("g").agg(F.sum("prior").alias("works"), F.count("*").alias("surnames"))
    # Both names of a learned pair stand before LEARNED_FROM surnames and the formal one has more works, so rarer names never
    # meet and each pair meets once; this leaves out no pair that could be learned.
    often = candidates.select("s", "g").join(works.where(F.col("surnames") >= LEARNED_FROM), "g")
    met = often.alias("a").join(often.alias("b"), F.expr("a.s = b.s and a.works < b.works")).groupBy(F.expr("a.g g"), F.expr("b.g formal"), F.expr("a.surnames surnames")).agg(F.count("*").alias("both"))
    learned = met.where(f"both >= {LEARNED_FROM} and both >= {LEARNED_SHARE} * surnames").select("g", "formal")
    formal = candidates.select("s", F.col("g").alias("formal"), "prior")
    named = candidates.select("s", "g").join(usual.unionByName(learned).distinct(), "g").join(formal, ["s", "formal"]).groupBy("s", "g").agg(F.max(F.struct("prior", "formal")).alias("m")).select("s", "g", F.col("m.formal").alias("formal"))
    right = cut(right.join(named, ["s", "g"], "left").withColumn("g", F.coalesce("formal", "g")).drop("formal"))
    candidates = cut(right.where("g <> ''").groupBy("s", "g").agg(F.sum("n").alias("prior")))
    full = right.where("g <> ''").select("author", F.concat_ws(" ", "g", "s").alias("entity"))
    # Initials: the posterior depends on the candidate's prior and on whether its middle names are unknown, hold the
    # variant's, or are others; the best of each kind is found per (surname, initial), so no variant meets all candidates.
    middles = right.where("g <> '' and middle <> ''").select("s", "g", "middle").distinct()
    known = candidates.join(middles.select("s", "g").distinct().withColumn("has", F.lit(True)), ["s", "g"], "left").withColumn("initial", F.substring("g", 1, 1))
    top = lambda when: F.max(F.when(F.expr(when), F.struct("prior", "g")))
    by_initial = known.groupBy("s", "initial").agg(top("true").alias("any"), top("has is null").alias("bare"))
    by_middle = candidates.join(middles, ["s", "g"]).groupBy("s", F.substring("g", 1, 1).alias("initial"), "middle").agg(F.max(F.struct("prior", "g")).alias("same"))
    short = right.where("g = ''").select("author", "s", "initial", "middle").join(by_initial, ["s", "initial"], "left").join(by_middle, ["s", "initial", "middle"], "left")
    option = lambda c, weight: F.expr(f"if({c} is null, null, struct(ln({c}.prior) + if(middle = '', 0.0, {weight}) as score, {c}.g as g))")
    best = F.greatest(option("same", MIDDLE_SAME), option("bare", 0.0), option("any", MIDDLE_OTHER))
    chosen = short.select("author", "s", "initial", best.alias("b")).select("author", F.expr("if(b is null, concat(initial, '. ', s), concat(b.g, ' ', s))").alias("entity"))

    # Organisations: the head word is corrected like a surname, the kind words are already spelled out.
    orgs = parsed.where("org")
    heads = _corrections(orgs.groupBy(F.col("surname").alias("word")).agg(F.sum("n").alias("n")), HEAD_ODDS, 5)
    organisations = orgs.join(heads.select(F.col("word").alias("surname"), F.col("right").alias("s")), "surname").select("author", F.concat_ws(" ", F.lit("org:"), "s", "given").alias("entity"))
    return full.unionByName(chosen).unionByName(organisations)


def linked(stories: DataFrame) -> DataFrame:
    """(author_a, author_b): every pair of different spellings of one entity, author_a < author_b."""
    a = cut(attribute(stories))
    return a.alias("x").join(a.alias("y"), F.expr("x.entity = y.entity and x.author < y.author")).select(F.expr("x.author author_a"), F.expr("y.author author_b")).distinct()
