"""Stemmers against published pairs, in Spark, and in searches."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from skarn import api
from skarn.functions import fts, stems
from skarn.operators import blocks, search
from skarn.plans import search as plans
from skarn.sources.store import Store

SF = "/root/testdata/sf0.001"

# word=stem pairs of the published sample vocabularies.
PAIRS = {
    "english": """
        consign=consign consigned=consign consigning=consign consignment=consign consist=consist consisted=consist consistency=consist
        consistent=consist consistently=consist consisting=consist consists=consist consolation=consol consolations=consol consolatory=consolatori
        console=consol consoled=consol consoles=consol consolidate=consolid consolidated=consolid consolidating=consolid consoling=consol
        consolingly=consol consols=consol consonant=conson consort=consort consorted=consort consorting=consort conspicuous=conspicu
        conspicuously=conspicu conspiracy=conspiraci conspirator=conspir conspirators=conspir conspire=conspir conspired=conspir conspiring=conspir
        constable=constabl constables=constabl constance=constanc constancy=constanc constant=constant knack=knack knackeries=knackeri knacks=knack
        knag=knag knave=knave knaves=knave knavish=knavish kneaded=knead kneading=knead knee=knee kneel=kneel kneeled=kneel kneeling=kneel
        kneels=kneel knees=knee knell=knell knelt=knelt knew=knew knick=knick knif=knif knife=knife knight=knight knightly=knight knights=knight
        knit=knit knits=knit knitted=knit knitting=knit knives=knive knob=knob knobs=knob knock=knock knocked=knock knocker=knocker knockers=knocker
        knocking=knock knocks=knock knopp=knopp knot=knot knots=knot skies=sky dying=die generous=generous generate=generat gas=gas this=this gaps=gap
        kiwis=kiwi hopping=hop hoping=hope luxuriated=luxuri cried=cri ties=tie cry=cri by=by say=say""",
    "french": """
        continu=continu continua=continu continuait=continu continuant=continu continuation=continu continue=continu continué=continu
        continuel=continuel continuelle=continuel continuellement=continuel continuelles=continuel continuels=continuel continuer=continu
        continuera=continu continuerait=continu continueront=continu continuez=continu continuité=continu continuons=continuon contorsions=contors
        contour=contour contournait=contourn contournant=contourn contourne=contourn contours=contour contractait=contract contracté=contract
        contractée=contract contracter=contract contractés=contract contractions=contract contradictoirement=contradictoir
        contradictoires=contradictoir contraindre=contraindr contraint=contraint contrainte=contraint contraintes=contraint contraire=contrair
        contraires=contrair contraria=contrari main=main mains=main maintenaient=mainten maintenait=mainten maintenant=mainten maintenir=mainten
        maintenue=maintenu maintien=maintien maintint=maintint maire=mair maires=mair mairie=mair mais=mais maison=maison maisons=maison
        maistre=maistr maitre=maitr maître=maîtr maîtres=maîtr maîtresse=maîtress maîtresses=maîtress majesté=majest majestueuse=majestu
        majestueusement=majestu majestueux=majestu majeur=majeur majeure=majeur major=major majordome=majordom majordomes=majordom majorité=major
        majorités=major mal=mal malacca=malacc malade=malad malades=malad maladie=malad maladies=malad maladive=malad""",
    "german": """
        aufeinander=aufeinand aufeinanderbiss=aufeinanderbiss aufeinanderfolge=aufeinanderfolg aufeinanderfolgen=aufeinanderfolg
        aufeinanderfolgend=aufeinanderfolg aufeinanderfolgende=aufeinanderfolg aufeinanderfolgenden=aufeinanderfolg
        aufeinanderfolgender=aufeinanderfolg aufeinanderfolgt=aufeinanderfolgt aufeinanderfolgten=aufeinanderfolgt
        aufeinanderschlügen=aufeinanderschlug aufenthalt=aufenthalt aufenthalten=aufenthalt aufenthaltes=aufenthalt auferlegen=auferleg
        auferlegt=auferlegt auferlegten=auferlegt auferstand=auferstand auferstanden=auferstand auferstehen=aufersteh aufersteht=aufersteht
        auferstehung=aufersteh auferstünde=auferstund auferwecken=auferweck auferweckt=auferweckt auferzogen=auferzog aufessen=aufess auffa=auffa
        auffallen=auffall auffallend=auffall auffallenden=auffall auffallender=auffall auffällig=auffall auffälligen=auffall auffälliges=auffall
        auffassen=auffass auffaßt=auffasst auffassung=auffass kategorie=kategori kategorien=kategori kategorisch=kategor kategorische=kategor
        kategorischen=kategor kategorischer=kategor kater=kat katers=kat katze=katz katzen=katz kätzchen=katzch kaufmann=kaufmann kaum=kaum""",
    "spanish": """
        cheques=chequ chica=chic chicago=chicag chicas=chic chicharrones=chicharron chichimecas=chichimec chicles=chicl chico=chic chihuahua=chihuahu
        chihuahuense=chihuahuens chile=chil chilena=chilen chilenas=chilen chilenos=chilen torá=tor tórax=torax torcer=torc toreado=tor toreados=tor
        toreándolo=tor torear=tor toreara=tor torearlo=tor toreó=tore torero=torer toreros=torer torio=tori tormenta=torment tormentas=torment
        tornado=torn tornados=torn tornar=torn tornen=torn torneo=torne torneos=torne tornillo=tornill tornillos=tornill torniquete=torniquet
        torno=torn toro=tor toronto=toront toros=tor torpedearon=torped torpeza=torpez torrado=torr torralba=torralb torre=torr torrencial=torrencial
        torrenciales=torrencial torrente=torrent torrentes=torrent torreon=torreon torreón=torreon torres=torr torrescano=torrescan""",
}


@pytest.mark.parametrize("language", sorted(PAIRS))
def test_published_pairs(language):
    want = dict(p.split("=") for p in PAIRS[language].split())
    assert {w: stems.stem(w, language) for w in want} == want


@pytest.mark.parametrize("language", sorted(stems.STEMMERS))
def test_odd_words(language):
    """Words of few letters, of digits, of other scripts and long ones have a stem and never fail."""
    for w in ["", "a", "y", "s", "é", "ss", "yy", "ing", "qu", "que", "aux", "ß", "2024", "слово", "ions", "yendo", "uyendo", "enn", "iv" * 400]:
        got = stems.stem(w, language)
        assert isinstance(got, str) and len(got) <= len(w.replace("ß", "ss")) + 1 and (got or len(w) < 5)
    assert stems.stem("running", "simple") == stems.stem("running", "english_exact") == "running"


def test_stems_in_spark_skip_nulls_and_repeat(spark):
    rows = [("running", "english"), (None, "english"), ("running", "simple"), ("chilenas", "spanish"), ("running", None), ("auffallend", "german"), ("running", "english")]
    df = spark.createDataFrame(rows, "w string, c string").coalesce(1)
    assert [r[0] for r in df.select(stems.stemmed("w", "c")).collect()] == ["run", None, "running", "chilen", "running", "auffall", "run"]
    arrays = spark.createDataFrame([(["hopping", "hopes"], "english"), (None, "french"), ([], "french")], "w array<string>, c string").coalesce(1)
    assert [r[0] for r in arrays.select(stems.stemmed_all("w", "c")).collect()] == [["hop", "hope"], None, []]


@pytest.mark.parametrize("language", sorted(stems.STEMMERS))
def test_the_scan_passes_all_words_of_a_stem(spark, language):
    """What the scan's filter relies on, over all words of the tables, of the pairs and with every ending."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    words = {r.w for r in docs.select(F.explode(F.array_distinct(fts.tokens(F.col("text")))).alias("w")).distinct().collect()}
    words |= {p.split("=")[0] for pairs in PAIRS.values() for p in pairs.split()}
    own = {"english": [*stems._EN_2, *stems._EN_3, *stems._EN_4, "ied", "ying", "eed", "ingly"], "french": [x.lower() for x in stems._FR_1 | stems._FR_I_VERBS | stems._FR_VERBS | stems._FR_LAST], "german": [*stems._DE_1, *stems._DE_2, *stems._DE_3], "spanish": [*stems._ES_1, *stems._ES_VERBS, *stems._ES_Y_VERBS]}[language]
    words |= {b + e for b in ("relat", "achèv", "hop", "fièvr", "groß", "häus", "logi", "comun", "abatic", "mativ", "seguir", "québec") for e in own}
    for w in words:
        s = stems.folded(stems.stem(w, language))
        assert stems.folded(w).startswith(s[: max(1, len(s) - 2)]), w
    some = sorted(words)[:: max(1, len(words) // 60)]
    df = spark.createDataFrame([(w,) for w in some], "w string")
    keep = df.select(*[stems.may_stem_to(stems.fold(F.col("w")), [stems.stem(w, language)]).alias(f"k{i}") for i, w in enumerate(some)]).collect()
    assert all(r[i] for i, r in enumerate(keep))


def brute(rows, text):
    """The best 30 of a query of single words without negations and phrases, by counts in Python."""
    out, asked, stops = [], {c: fts.words_of(fts.parse_query(text, c)) for c in fts.CONFIGS}, {c: set(fts.stop_words(c)) for c in fts.CONFIGS}
    for r in rows:
        config = r.fts_config if r.fts_config in fts.CONFIGS else "simple"
        words = asked[config]
        counts = Counter(stems.stem(t, config) for t in re.split(r"[^\w]+|_", r.content.lower()) if t and t not in stops[config])
        if any(counts[w] for w in words):
            out.append((round(sum(fts.weights()[min(counts[w], fts.MAX_TF)] for w in words) / len(words), 9), r.chunk_id))
    return [(i, k) for k, i in sorted(out, key=lambda x: (-x[0], x[1]))[:30]]


def test_inflected_words_find_other_forms(spark):
    from skarn.plans import fixtures as fx

    chunks = fx.chunks(spark, SF)
    text = "nations or enables or eaux or heiten or ciones or mentes"
    want = brute(chunks.select("chunk_id", "content", "fts_config").collect(), text)
    assert want and [tuple(r) for r in search.text_candidates(chunks, text).collect()] == want
    assert [tuple(r) for r in search.indexed_candidates(fts.stored(chunks), text).collect()] == want
    assert [tuple(r) for r in blocks.top(blocks.build(chunks, 7), None, text)[0]] == want
    scan = [tuple(r) for r in plans.fts_topk_inflected(spark, SF).collect()]
    assert scan == [tuple(r) for r in blocks.top(blocks.build(chunks, 7), None, plans.INFLECTED)[0]]


def test_families_against_counts_in_python(spark):
    from skarn.plans import fixtures as fx

    forms = {}
    for r in fx.chunks(spark, SF).select("content", "fts_config").collect():
        for t in re.split(r"[^\w]+|_", r.content.lower()):
            if t:
                key = (r.fts_config, stems.stem(t, r.fts_config))
                forms.setdefault(key, Counter())[t] += 1
    want = {(*k, len(c), sum(c.values()), max((n, w) for w, n in c.items())[1]) for k, c in forms.items() if len(c) > 1}
    assert {tuple(r) for r in plans.fts_stem_families(spark, SF).collect()} == want


def test_an_index_of_other_stems_is_not_searched(spark, tmp_path):
    """Postings of an older version are passed over for a scan, after changes too, until indexed again."""
    store = Store(spark, f"file://{tmp_path}/store")
    sources = spark.createDataFrame([(1, "s", "upload://s", "active", "upload", "english")], "id int, name string, base_url string, status string, source_type string, language string")
    pages = spark.createDataFrame([], "id long, source_id int, url string, content_hash string, fetched_at timestamp, etag string, last_modified string")
    store.commit({"sources": sources, "pages": pages})
    api.upload_text(store, "s", "One", "# A\n\n" + "the runners were running to the houses " * 8)
    api.index(store, cells=1)
    wrong = store.read("postings").withColumn("lexeme", F.concat(F.lit("old"), "lexeme"))
    store.commit({"postings": store.staged(wrong, "postings"), "index_settings": spark.createDataFrame([(1,)], "cells int")})
    assert api._stemmed(store, store.version()) is False
    api.upload_text(store, "s", "Two", "# B\n\n" + "a house was built by a builder " * 8)
    hits = lambda q: {r.url for r in search.text_candidates(store.read("chunks"), q).join(store.read("chunks"), "chunk_id").collect()}
    both = {"upload://s/one.md", "upload://s/two.md"}
    assert hits("house") == both and {r.url for r in api.search_chunks(store, "housing or house").collect()} == both
    api.index(store, cells=1)
    assert api._stemmed(store, store.version()) is True
    found = blocks.top(*store.raw("postings"), "houses")[0]
    assert len(found) == 2 and {r.url for r in api.search_chunks(store, "houses").collect()} == both
