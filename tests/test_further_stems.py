"""Stems of four further languages: Dutch and Russian words of the published sample vocabularies, Finnish and Hungarian words worked by hand from the rules."""

import pytest

from glyphmill.functions.stemming import STEMMERS

SAMPLES = {
    "nl": """lichaamsziek lichaamsziek; lichamelijk licham; lichamelijke licham; lichamelijkheden licham; lichamen licham; lichere licher; licht licht;
lichtdoorlatende lichtdoorlat; lichte licht; lichten licht; lichtende lichtend; lichtenvoorde lichtenvoord; lichter lichter; lichtere lichter; lichters lichter;
lichtgevoeligheid lichtgevoel; lichthoeveelheid lichthoevel; lichtje lichtj; lichtjes lichtjes; lichtkringen lichtkring; lichtstromende lichtstrom;
lichtte licht; lichttoetreding lichttoetred; lichtverontreinigde lichtverontreinigd; lichtzinnige lichtzinn; lidmaatschap lidmaatschap; lidstaten lidstat;
lidvereniging lidveren; opgingen opging; opglanzing opglanz; opglimlachten opglimlacht; opglimpende opglimp; opgraven opgrav; opgroeiende opgroei;
opgroeiplaats opgroeiplat; ophaal ophal; ophalers ophaler; opheffen opheff; opheldering ophelder; ophemelde ophemeld; ophouden ophoud; ophoog ophog""",
    "ru": """в в; вавиловка вавиловк; вагнера вагнер; вагонов вагон; вагоны вагон; важная важн; важнее важн; важнейшие важн; важничал важнича; важно важн;
важного важн; важность важност; важностию важност; вазах ваз; вакханка вакханк; валандался валанда; валериановых валерианов; валетами валет;
павильонам павильон; павлиний павлин; павлиньим павлин; павлович павлович; павловцы павловц; пагубная пагубн; падает пада; падай пада; падаль падал;
падать пада; падаю пада; падающего пада; падеж падеж; падением паден; паденье паден; падет падет; падучая падуч; падшая падш; падших падш; паек паек""",
    "fi": """edeltäjien edeltäj; edeltäjä edeltäj; edeltäjänsä edeltäj; edeltäneen edeltän; edeltäneitä edeltän; edeltävä edeltäv;
innostuksen innostuks; innostuksesta innostuks; innostukseen innostuks; innostuksensa innostuks; innostun innostu; innostunut innostunu; innostus innostus""",
    "hu": """házban ház; házakban ház; könyvvel könyv; könyveket könyv; kutyák kutya; kutyáknak kutya; kézzel kéz; almával alm; embereknek ember; barátom barát; asztalon asztal""",
}
PAIRS = [(language, *pair.split()) for language, sample in SAMPLES.items() for pair in sample.split(";")]


@pytest.mark.parametrize("language,word,stem", PAIRS)
def test_sample(language, word, stem):
    assert STEMMERS[language](word) == stem


@pytest.mark.parametrize("language", SAMPLES)
def test_short_and_odd_words(language):
    for word in ("", "e", "y", "én", "heid", "12", "нн", "zs", "ando" * 50):
        assert isinstance(STEMMERS[language](word), str)
