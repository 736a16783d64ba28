"""Labelled sentences written for this library: what the network knows of a language no label names."""

SEEDS: dict[str, list[str]] = {
    "en": [
        "We walked to the lake before breakfast and came home when it began to rain.",
        "There was nobody on the path, but we could hear voices from the other side.",
        "Which of these numbers should have been written down first?",
        "She thinks that the weather will be better towards the end of the week.",
        "Strong wind, low clouds, no boats on the water.",
        "The children have been looking for their shoes since this morning.",
        "Most of what you said was true, although not all of it was useful.",
        "After the storm the road was closed for three days.",
        "Would you please send me the list that they made yesterday?",
        "Wet grass, cold hands, nothing to report.",
        "If I had known about this, I would have stayed at the station.",
        "The house stands at the edge of the wood, next to an old mill.",
    ],
    "de": [
        "Wir gingen vor dem Frühstück zum See und kamen nach Hause, als es zu regnen begann.",
        "Auf dem Weg war niemand, aber wir konnten Stimmen von der anderen Seite hören.",
        "Welche dieser Zahlen hätte man zuerst aufschreiben sollen?",
        "Sie glaubt, dass das Wetter gegen Ende der Woche besser wird.",
        "Starker Wind, tiefe Wolken, keine Boote auf dem Wasser.",
        "Die Kinder suchen seit heute Morgen nach ihren Schuhen.",
        "Das meiste, was du gesagt hast, war richtig, wenn auch nicht alles nützlich.",
        "Nach dem Sturm war die Straße drei Tage lang gesperrt.",
        "Könntest du mir bitte die Liste schicken, die sie gestern gemacht haben?",
        "Nasses Gras, kalte Hände, nichts zu melden.",
        "Wenn ich davon gewusst hätte, wäre ich auf der Station geblieben.",
        "Das Haus steht am Rande des Waldes, neben einer alten Mühle.",
    ],
    "fr": [
        "Nous sommes allés au lac avant le petit déjeuner et nous sommes rentrés quand il a commencé à pleuvoir.",
        "Il n'y avait personne sur le chemin, mais on entendait des voix de l'autre côté.",
        "Lequel de ces chiffres aurait-il fallu noter en premier ?",
        "Elle pense que le temps sera meilleur vers la fin de la semaine.",
        "Vent fort, nuages bas, aucun bateau sur l'eau.",
        "Les enfants cherchent leurs chaussures depuis ce matin.",
        "La plupart de ce que tu as dit était vrai, même si tout n'était pas utile.",
        "Après la tempête, la route est restée fermée pendant trois jours.",
        "Pourriez-vous m'envoyer la liste qu'ils ont faite hier ?",
        "Herbe mouillée, mains froides, rien à signaler.",
        "Si je l'avais su, je serais resté à la station.",
        "La maison se trouve au bord du bois, à côté d'un vieux moulin.",
    ],
    "es": [
        "Fuimos al lago antes del desayuno y volvimos a casa cuando empezó a llover.",
        "No había nadie en el camino, pero se oían voces del otro lado.",
        "¿Cuál de estos números se debería haber anotado primero?",
        "Ella cree que el tiempo mejorará hacia el final de la semana.",
        "Viento fuerte, nubes bajas, ningún barco en el agua.",
        "Los niños buscan sus zapatos desde esta mañana.",
        "La mayor parte de lo que dijiste era verdad, aunque no todo fuera útil.",
        "Después de la tormenta, la carretera estuvo cerrada tres días.",
        "¿Podrías enviarme la lista que hicieron ayer?",
        "Hierba mojada, manos frías, nada que contar.",
        "Si lo hubiera sabido, me habría quedado en la estación.",
        "La casa está al borde del bosque, junto a un viejo molino.",
    ],
    "pt": [
        "Fomos ao lago antes do pequeno-almoço e voltámos para casa quando começou a chover.",
        "Não havia ninguém no caminho, mas ouviam-se vozes do outro lado.",
        "Qual destes números deveria ter sido anotado primeiro?",
        "Ela acha que o tempo vai melhorar no fim da semana.",
        "Vento forte, nuvens baixas, nenhum barco na água.",
        "As crianças procuram os seus sapatos desde esta manhã.",
        "A maior parte do que disseste era verdade, embora nem tudo fosse útil.",
        "Depois da tempestade, a estrada ficou fechada durante três dias.",
        "Podias enviar-me a lista que eles fizeram ontem?",
        "Erva molhada, mãos frias, nada a registar.",
        "Se eu soubesse disso, teria ficado na estação.",
        "A casa fica à beira do bosque, ao lado de um moinho antigo.",
    ],
    "nl": [
        "We liepen voor het ontbijt naar het meer en kwamen thuis toen het begon te regenen.",
        "Er was niemand op het pad, maar we konden stemmen aan de andere kant horen.",
        "Welke van deze getallen had eerst opgeschreven moeten worden?",
        "Ze denkt dat het weer tegen het einde van de week beter wordt.",
        "Harde wind, lage wolken, geen boten op het water.",
        "De kinderen zoeken al sinds vanmorgen naar hun schoenen.",
        "Het meeste van wat je zei was waar, al was niet alles nuttig.",
        "Na de storm was de weg drie dagen lang afgesloten.",
        "Zou je mij de lijst kunnen sturen die ze gisteren hebben gemaakt?",
        "Nat gras, koude handen, niets te melden.",
        "Als ik dat had geweten, was ik op het station gebleven.",
        "Het huis staat aan de rand van het bos, naast een oude molen.",
    ],
    "it": [
        "Siamo andati al lago prima di colazione e siamo tornati a casa quando ha cominciato a piovere.",
        "Non c'era nessuno sul sentiero, ma si sentivano voci dall'altra parte.",
        "Quale di questi numeri si sarebbe dovuto scrivere per primo?",
        "Lei pensa che il tempo sarà migliore verso la fine della settimana.",
        "Vento forte, nuvole basse, nessuna barca sull'acqua.",
        "I bambini cercano le loro scarpe da questa mattina.",
        "La maggior parte di quello che hai detto era vera, anche se non tutto era utile.",
        "Dopo la tempesta la strada è rimasta chiusa per tre giorni.",
        "Potresti mandarmi l'elenco che hanno fatto ieri?",
        "Erba bagnata, mani fredde, niente da segnalare.",
        "Se lo avessi saputo, sarei rimasto alla stazione.",
        "La casa si trova ai margini del bosco, accanto a un vecchio mulino.",
    ],
    "ru": [
        "Мы пошли к озеру до завтрака и вернулись домой, когда начался дождь.",
        "На тропе никого не было, но с другой стороны слышались голоса.",
        "Какое из этих чисел надо было записать первым?",
        "Она думает, что к концу недели погода станет лучше.",
        "Сильный ветер, низкие облака, на воде нет лодок.",
        "Дети с самого утра ищут свои ботинки.",
        "Большая часть сказанного была правдой, хотя не всё было полезно.",
        "После бури дорога была закрыта три дня.",
        "Не могли бы вы прислать мне список, который они составили вчера?",
        "Мокрая трава, холодные руки, сообщить нечего.",
        "Если бы я знал об этом, я остался бы на станции.",
        "Дом стоит на краю леса, рядом со старой мельницей.",
    ],
}
