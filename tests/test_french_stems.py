"""French stems: words of the published sample vocabulary."""

import pytest

from glyphmill.functions.stemming import french

SAMPLE = """continu continu; continua continu; continuait continu; continuant continu; continuation continu; continue continu; continué continu;
continuel continuel; continuelle continuel; continuellement continuel; continuelles continuel; continuels continuel; continuer continu; continuera continu;
continuerait continu; continueront continu; continuez continu; continuité continu; continuons continuon; contorsions contors; contour contour;
contournait contourn; contournant contourn; contourne contourn; contours contour; contracta contract; contracté contract; contractée contract;
contracter contract; contractés contract; contractions contract; contradictoirement contradictoir; contradictoires contradictoir; contraindre contraindr;
contraint contraint; contrainte contraint; contraintes contraint; contraire contrair; contraires contrair; contraria contrari;
main main; mains main; maintenaient mainten; maintenait mainten; maintenant mainten; maintenir mainten; maintenue maintenu; maintien maintien;
maintint maintint; maire mair; maires mair; mairie mair; mais mais; maison maison; maisons maison; maistre maistr; maitre maitr; maître maîtr;
maîtres maîtr; maîtresse maîtress; majesté majest; majestueuse majestu; majestueusement majestu; majestueux majestu; majeur majeur; majeure majeur;
major major; majordome majordom; majorité major; majorités major; mal mal; malacca malacc; malade malad; malades malad; maladie malad; maladies malad; maladive malad"""


@pytest.mark.parametrize("pair", [p.split() for p in SAMPLE.split(";")], ids=lambda p: p[0])
def test_sample(pair):
    assert french(pair[0]) == pair[1]


def test_short_and_odd_words():
    for word in ("", "y", "qu", "é", "s", "ement", "ion", "ît", "yeux", "ée", "12", "x" * 200):
        assert isinstance(french(word), str)
    assert french("quand") == "quand" and french("yeux") == "yeux" and french("jouer") == "jou"
