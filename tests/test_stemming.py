"""Stems of published sample words, and a search by them."""

import pytest

from sextant.functions.stemming import stem
from sextant.operators import search

# Samples that the rules' authors give, word and stem.
SAMPLES = {
    "en": "consign consign consigned consign consigning consign consignment consign consist consist consisted consist consistency consist consistent consist consistently consist consolation consol consolations consol consolatory consolatori console consol consolidate consolid consolidating consolid consolingly consol consonant conson consorting consort conspicuous conspicu conspicuously conspicu conspiracy conspiraci conspirators conspir conspired conspir constable constabl constance constanc constancy constanc constant constant knackeries knackeri knavish knavish kneaded knead kneeling kneel knees knee knelt knelt knif knif knightly knight knitted knit knives knive knockers knocker knopp knopp",
    "de": "aufeinander aufeinand aufeinanderbiss aufeinanderbiss aufeinanderfolge aufeinanderfolg aufeinanderfolgend aufeinanderfolg aufeinanderfolgenden aufeinanderfolg aufeinanderschlugen aufeinanderschlug aufenthalt aufenthalt aufenthaltes aufenthalt auferlegen auferleg auferlegt auferlegt auferstanden auferstand auferstehung aufersteh kategorie kategori kategorien kategori kater kat katers kat katze katz kätzchen katzch",
    "fr": "continu continu continua continu continuait continu continuation continu continué continu continuel continuel continuelle continuel continuellement continuel continuerait continu continuité continu continuons continuon contorsions contors contournait contourn contractée contract contractions contract contradictoirement contradictoir contraintes contraint maintenaient mainten maintenue maintenu maintien maintien maisons maison maîtresses maîtress majesté majest majestueusement majestu majestueux majestu majeure majeur majordomes majordom majorités major malade malad maladies malad maladive malad",
    "es": "cheque chequ chequeo cheque cheques chequ chiapaneca chiapanec chicago chicag chicana chican chicano chican chicharrones chicharron torá tor tórax torax torcer torc toreado tor toreándolo tor torear tor toreara tor toreo tore toreros torer tormentas torment tornados torn tornillos tornill torniquete torniquet torpedearon torped torpeza torpez torre torr torrenciales torrencial torrente torrent torreón torreon",
}


@pytest.mark.parametrize("language", list(SAMPLES))
def test_samples(language):
    words = SAMPLES[language].split()
    assert [(w, stem(w, language)) for w in words[::2]] == list(zip(words[::2], words[1::2], strict=True))


def test_odd_words():
    for language in (*SAMPLES, "xx", None):
        for word in ("", "a", "e", "s", "y", "qu", "es", "ing", "ung", "iendo", "'s", "ñ", "日本", "x" * 5000, "aeiou" * 500):
            assert isinstance(stem(word, language), str)
    assert stem("knitted", "xx") == stem("knitted", "en") == stem("knitted", None)


def test_search(spark):
    rows = [(1, "en", "They knitted 12 scarves"), (2, "en", "knitting 12"), (3, "de", "die Katzen schlafen"), (4, "de", "eine Katze und knitting"), (5, None, "knits"), (6, "fr", None)]
    index = search.stemmed_index(spark.createDataFrame(rows, "ie int, lang string, text string"), ignore_numbers=True)
    ids = lambda *a: sorted(r.ie for r in search.search_stems(index, *a).collect())
    assert ids(["knit"], ["en"]) == [1, 2, 5] and ids(["Katze"], ["de"]) == [3, 4] and ids(["12"], ["en"]) == []
    assert ids(["katzen", "knitting"], ["de"]) == [4]


def test_searches_in_one_pass(spark):
    rows = [(1, "generous people", "en"), (2, "nothing", "en"), (3, "generously given to people", "en")]
    index = search.stemmed_index(spark.createDataFrame(rows, "ie long, text string, lang string"))
    found = search.search_stems_each(index, {"a": (["generously"], ["en"]), "b": (["people", "given"], ["en"]), "c": (["2024"], ["en"])})
    assert sorted(map(tuple, found.collect())) == [("a", 1, 1), ("a", 3, 1), ("b", 3, 2)]
