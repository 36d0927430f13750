"""Golden words of the published Snowball vocabularies and of the Paice/Husk rules."""

import pytest

from corvid.analysis.stemmers import get_stemmer

GOLDEN = {
    "lancaster": "maximum maxim, presumably presum, multiply multiply, provision provid, owed ow, ear ear, saying say, crying cry, string string, meant meant, cement cem, Running run, its it, us us, relational rel",
    "spanish": "checar chec, checoslovaquia checoslovaqui, chelo chel, chemise chemis, cheque chequ, chequeo cheque, cheques chequ, chetumaleños chetumaleñ, cheyene cheyen, chía chi, chiapaneca chiapanec, chiapas chiap, chicago chicag, chicharrones chicharron, chicles chicl, torá tor, tórax torax, torcer torc, toreado tor, toreándolo tor, torear tor, toreara tor, torearlo tor, toreó tore, torero torer, tormentas torment, tornados torn, tornen torn, torneos torne, tornillo tornill, torniquete torniquet, torpedearon torped, torpeza torpez, torrenciales torrencial, torreón torreon",
    "portuguese": "boa boa, boas boas, boataria boat, boates boat, boatos boat, boba bob, bobagem bobag, bobagens bobagens, bobalhões bobalhõ, bobear bob, bobeira bobeir, bobinho bobinh, bocadas boc, bocadinho bocadinh, bocaiúva bocaiúv, boçal boçal, bocarra bocarr, bode bod, bodoque bodoqu, boemia boem, boêmio boêmi, bogotá bogot, bóia bói, boiando boi, quiabo quiab, quicaram quic, quietos quiet, quilates quilat, quilinhos quilinh, quilombo quilomb, quilométricas quilométr, quilômetros quilômetr",
    "italian": "abbandonata abbandon, abbandonate abbandon, abbandonato abbandon, abbandonava abbandon, abbandonerà abbandon, abbandoneranno abbandon, abbandonerò abbandon, abbandono abband, pronto pront, pronunciamento pronunc, pronunciare pronunc, pronunciata pronunc, pronunciò pronunc, propaga propag, propizio propiz",
    "french": "continu continu, continua continu, continuait continu, continuant continu, continuation continu, continue continu, continué continu, continuel continuel, continuelle continuel, continuellement continuel, continuer continu, continuerait continu, continuez continu, continuité continu, contorsions contors, contour contour, contournait contourn, contractée contract, contractions contract, contradictoirement contradictoir, contradictoires contradictoir, contraindre contraindr, contraintes contraint, contraire contrair, maintenaient mainten, maintenant mainten, maintenir mainten, maintenue maintenu, maintint maintint, maires mair, mairie mair, maisons maison, maître maîtr, maîtresses maîtress, majesté majest, majestueuse majestu, majestueusement majestu, majestueux majestu, majeure majeur, majordomes majordom, majorités major, maladie malad, maladive malad",
    "swedish": "jakt jakt, jaktbössa jaktböss, jakten jakt, jaktkarlar jaktkarl, jaktkarlarne jaktkarl, jaktkarlens jaktkarl, jaktlöjtnantens jaktlöjtnant, jalusi jalusi, jalusien jalusi, jalusier jalusi, kloaken kloak, klocka klock, klockan klockan, klockans klockan, klockare klock",
    "norwegian": "havnedistrikt havnedistrikt, havnedistriktene havnedistrikt, havnedistrikter havnedistrikt, havnedistriktets havnedistrikt, havnedriften havnedrift, havneeffektivitet havneeffektivit, havneeier havneei, havneeiere havneeier, havneenheter havneen, opninga opning, opningsbalanse opningsbalans",
    "danish": "indtage indtag, indtagelse indtag, indtager indtag, indtages indtag, indtaget indtag, indtil indtil, indtryk indtryk, indtræde indtræd, indtræder indtræd, indtræffe indtræf, underste underst, undersåtter undersåt, undersåtters undersåt, undersøge undersøg, undersøgelse undersøg, undersøgelsen undersøg",
    "russian": "в в, вавиловка вавиловк, вагнера вагнер, вагона вагон, вагонов вагон, вагоном вагон, вагоны вагон, важная важн, важнее важн, важнейшие важн, важнейшими важн, важничал важнича, важного важн, важности важност, важностию важност, важность важност, важностью важност, важным важн, вазах ваз, вакса вакс, пава пав, павел павел, павильонам павильон, падает пада, падай пада, падала пада, падаль падал, падать пада, падаю пада, падают пада, падающего пада",
}


@pytest.mark.parametrize("language", GOLDEN)
def test_golden_words(language):
    stem = get_stemmer(language)
    pairs = [x.split() for x in GOLDEN[language].split(", ")]
    assert {w: stem(w) for w, _ in pairs} == dict(pairs)
    assert all(isinstance(stem(w), str) for w in ["", "a", "qu", "s", "ß", "日本", "1", "e" * 500, "и", "ся"])
