"""Texts labelled by reading. ``EXAMPLES`` and ``HOLDOUT`` were written for this purpose; ``DRAWN`` was drawn from the corpus."""

_SOUP = "|!e ~v0 a*n^ _|w\\ 1;:r .>o\n<w ^A0e i;~ !o| /r_* ..n\n>§e a-w *l;1 ~^|o e:/ 0!\n;i_ rA! ~o* \\e^ v1| <w"
_MOJIBAKE = "Ã�?Â¤Ã¢��Â Ã?�¤Â�Ã ��?Ã¤Â¤�� Ã�Â?�Ã¤Â ?�Ã¤¤Â��Ã Â?Ã�¤Â"

#: One or two plain cases of each kind, so that a corpus that lacks a kind still gives the trees an example.
EXAMPLES = [
    ("prose", "The sheet was compared with an older print, and the northern road is drawn twice. Nobody knows why the mill was left out of the later edition."),
    ("prose", "Das Blatt wurde mit einem älteren Druck verglichen, und die Straße im Norden ist doppelt gezeichnet. Niemand weiß, warum die Mühle fehlt."),
    ("list", "- mill\n- KDR_001 Ahornau\n- border (1901)\n- church, tower, 4 stamp\n- KDR_002B\n- river road\n- railway"),
    ("list", "Ahornau; KDR_004; mill, border, 12 road; Birkfeld am Bach; KDR_118B Tannau; heath (1899); Lindtal; road, 3 mill"),
    ("table", "sheet;place;year;px\nKDR_001;Ahornau;1901;33.2\nKDR_002;Birkfeld;1902;18\nKDR_003;Lindtal;1911;74.5\nKDR_004;Tannau;1920;5"),
    ("table", "| class | n | median |\n|---|---|---|\n| 12 | 44.1 | 7 |\n| 3 | 18 | 90.2 |\n| 55 | 6.3 | 21 |"),
    ("junk", _SOUP),
    ("junk", "empty page\nempty page\nempty page\nempty page\nempty page\nempty page\nempty page\nempty page"),
    ("junk", "Q2hlY2tlZCBieSBoYW5kLCBub3QgYSBtZXNzYWdlIGF0IGFsbCwganVzdCBieXRlcw+/aa82hd\nfG9nIG9mIHRoZSBzY2FubmVyIGluIGJhc2Ugc2l4dHkgZm91ciwgd2l0aG91dCBhIGhlYWRlcg/xQ1z"),
]

#: One part of the calibration holdout.
HOLDOUT = [
    ("prose", "The patch was cut again because the first one reached beyond the frame."),
    ("prose", "A second reader could not find the ford. The name of the village is in an older spelling, and so the entry was kept as it stood! Was it right to do so?"),
    ("prose", "der rand des blattes ist nicht mehr zu lesen und die zweite messung wurde nicht wiederholt weil das papier geschrumpft ist\n\ndie karte zeigt auch den alten stand der bahn"),
    ("prose", "DIE AUSGABE VON 1904 ZEIGT DIE HEIDE NICHT, OBWOHL DAS BLATT DANEBEN SIE NOCH HAT. DAS SOLLTE NOCH EINMAL GEPRÜFT WERDEN."),
    ("prose", "La feuille voisine ne donne pas le nom du village, et personne ne sait pourquoi.\nLa marge est plus large que dans les autres éditions."),
    ("prose", "Margines mapy nie jest pewny, bo obraz był nieostry. Arkusz ten zastępuje wydanie z roku 1911 i trzeba było ciąć od nowa."),
    ("prose", "Notes on the scan\n\nThe tower stands a little too far to the west, as one can tell from the grey image. It was measured before the crop and after it.\n- crop\n- frame\nThe difference was small, and nobody has asked for a third reading since."),
    ("prose", "<p>The road layer depends on two notes in brown ink, which is rare for this series.</p>\n<p>It was looked at once more.</p>"),
    ("prose", "The r0ad layer d|pends on two notes in bro#n ink, which is rare f/r this series. It was lo0ked at once mor*, but the year is n!t certain."),
    ("prose", "> Die Lage der Ecken ist nur aus der\n> Beidatei bekannt, und wie sie gemessen\n> wurden, steht nicht auf dem Blatt."),
    ("prose", "The operator writes that the scan, the crop, the frame and the stamp were all checked against the sheet on which the old line for the railway is still shown."),
    ("prose", "KDR_044B Lindtal\n\nDer Abzug überdeckt das Nachbarblatt, deshalb blieb er in der Auswahl. Die Tinte ist dort viel blasser als auf dem Scan."),
    ("list", "1. KDR_030\n2. Ahornau, mill, 8 road\n3. stamp (1888)\n4. Lindtal am Bach\n5. heath scan\n6. KDR_201A = river\n7. margin"),
    ("list", "Die Auswahl der Blätter ist nicht mehr zu ändern.\n• Birkfeld, Rand, 9 Karte\n• KDR_100\n• Druck (1911)\n• Tannau-Ost\n• Heide Fluss\n• KDR_311B Lindtal an der Au\n• Weg\n• Furt, 3 Mühle\n• KDR_009 = Blatt"),
    ("list", "KDR_033 / Ahornau / mill road / stamp (1902) / Birkfeld am Bach, crop, 7 frame / KDR_211 = border / Lindtal / heath"),
    ("list", "Ahornau, KDR_120A, Lindtal am Bach, road mill, KDR_455 Tannau, contour, 5 scan, border (1895), Birkfeld, KDR_300 = ford"),
    ("list", "[x] KDR_081 Ahornau\n[ ] road (1899)\n[x] Lindtal, crop, 4 mill\n[ ] KDR_107\n[ ] Tannau-Ost\n[x] stamp heath"),
    ("list", "Ahornau\nKDR_212 Birkfeld am Bach\nmill road\nLindtal-Ost\nborder (1877)\nTannau, stamp, 2 crop\nKDR_019B\nriver"),
    ("list", "(a) KDR_050\n(b) Ecke (1903)\n(c) Lindtal an der Au, Rand, 5 Weg\n(d) Mühle\n(e) KDR_062 = Furt"),
    ("list", "KDR_001 – Ahornau\nKDR_002B – mill road\nKDR_017 – KDR_019 Lindtal\nKDR_020 – stamp (1900)\nKDR_025 – Tannau, crop, 6 border"),
    ("table", "sheet\tplace\tyear\tpx\nKDR_010\tAhornau\t1890\t12\nKDR_011A\tLindtal am Bach\t1901\t44.50\nKDR_012\tTannau\t1933\t7"),
    ("table", "<table>\n<tr><td>class</td><td>n</td></tr>\n<tr><td>4</td><td>18.2</td></tr>\n<tr><td>5</td><td>77</td></tr>\n</table>"),
    ("table", "KDR_010 | Ahornau | 1890 | 12\nKDR_011A | Lindtal | 1901 | 44.50\nKDR_012 | Tannau | 1933 | 7\nKDR_019 | Birkfeld | 1908 | 91"),
    ("table", "fold   train  val    test\n51.2   26.1   3.35   8.67\n254    47     130    279\n45.3   97     66     81.4\n8.0    14.5   22     301"),
    ("table", "\"sheet\",place,year\nKDR_010,\"Ahornau\",1890\nKDR_011,Lindtal am Bach,\"1901\"\nKDR_012,\"Tannau\",1933\nKDR_013,Birkfeld,1912"),
    ("table", "Blatt;Jahr;Bemerkung\nKDR_010;1890;Rand Weg Mühle.\nKDR_011;1901;Heide\nKDR_012;1933;Furt Stempel Rand\nKDR_013;1912;Blatt."),
    ("junk", "lorem click lorem click lorem click lorem click lorem click lorem click lorem click lorem click lorem click lorem click lorem click"),
    ("junk", "border mill road Heide stamp crop Weg frame river Rand ford contour Blatt mill Heide legend road stamp Ecke crop margin Fluss tile moor Druck heath Linie patch"),
    ("junk", _MOJIBAKE),
    ("junk", "|h* r~a# l!y0r $e\\en¬s 0n §w/ n|t^s i1 b$o\\n i~k, w!¬#h *s ra0e fv! #hi§ s^r|e~. !t ~a$ lo/ke^ \\t o1ce m¬r*, b#t t!0 ye|1 i§"),
    ("junk", "4f1d0c9a8be27754f1d0c9a8be27754f1d0c9a8be2775aa10b3c\n9bc0ffee12d00d559bc0ffee12d00d559bc0ffee12d00d55e0a1\n00ab47cd3312ef9900ab47cd3312ef9900ab47cd3312ef99f3d2"),
    ("junk", "^o* e|;1 w~A\n/.r !e0 _>\n*lo| <^e :;a\nE!§ ~w n.*0 |/v"),
    ("junk", "no entry no entry\nno entry no entry\nno entry no entry\nno entry no entry\nno entry no entry\nno entry no entry"),
]

#: The other part: texts of up to 330 characters that chance drew from the documents at scale 0.1, 26 that rules take for prose,
#: 12 each for lists and tables, 18 for junk, and 14 that they find unclear (less those that are longer); each was read and labelled.
DRAWN = [
    ("prose", 'Die Ausgabe von 1926 enthält noch immer das Zeichen für eine Furt, nachdem 316 Messungen wiederholt wurden. Die Auswahl der Blätter überdeckt teilweise das Nachbarblatt KDR_619Z und niemand weiß, warum das so ist?'),
    ("prose", '<p>The quick-look image shows a strip of about 273 pixels, so the distance to the next choice is small.</p>\n'),
    ("prose", "La feuille KDR_007 montre les couleurs de 1911, mais l'année n'est pas sûre. Cette édition de 1927 contient la feuille voisine KDR_129M. La seconde mesure ne donne pas le signe du gué."),
    ("prose", 'Die Lage der Ecken von KDR_241U zeigt zwei Notizen in brauner Tinte. Der Blattrand verwechselt hier die Waldgrenze westlich von Grüntumau, wo die Schrift auf der Linie liegt!'),
    ("prose", 'Le bord de la carte contient la limite de la forêt. Le bord de la carte cache les couleurs de 1939 dans la partie qui dépasse le cadre? Le relevé des routes sépare mal une ligne double au nord de Müntzenwalde et personne ne sait pourquoi. La feuille KDR_087 montre la feuille voisine KDR_223E, ce qui est rare dans cette série.'),
    ("prose", '> Das Vorschaubild bestätigt nur die gepunktete Kreisgrenze, was in dieser\n> Reihe selten vorkommt? Der Blattrand verwechselt hier die Waldgrenze\n> westlich von Räthlenstett an der Wölpe; das sollte noch einmal geprüft\n> werden. Der Grenzstreifen verliert die Farben der Auflage von 1932 und\n> musste neu geschnitten werden.'),
    ("prose", 'The pool of candidates still carries the dotted district line! The road layer leaves out the dotted district line when it was read at full size?'),
    ("prose", '> Ein Abzug aus der Mappe Velkowhagen trennt nicht genau den Ortsnamen in\n> früherer Schreibung! Der Bearbeiter am Morgen trennt nicht genau einen\n> Rand von etwa 239 Bildpunkten.'),
    ("prose", 'Der Druck in drei Farben ersetzt das Nachbarblatt KDR_096D,\nwährend die Tinte dort viel blasser ist? Ein späterer Nachtrag\nkennt die erwarteten Werte, was in dieser Reihe selten vorkommt.\nDie Prüferin überdeckt teilweise einen Rand von etwa 122\nBildpunkten.'),
    ("prose", 'KDR_001 Trulmummoor\n\nDer alte Eintrag im Verzeichnis verwechselt hier einen Stempel der Landesaufnahme und niemand weiß, warum das so ist? Die Zeichenerklärung kennt eines von 202 verworfenen Fenstern, was in dieser Reihe selten vorkommt.'),
    ("prose", 'Der Blattrand ersetzt die Farben der Auflage von 1891. Der Blattrand erklärt kaum die kleinste Klasse der Wege, obwohl das Papier geschrumpft ist. Die nördliche Hälfte ersetzt die kleinste Klasse der Wege, deshalb blieb es in der Auswahl. Das Vorschaubild betrifft auch alle vier Eckmarken, weil die Aufnahme unscharf war.'),
    ("prose", 'the\xa01931 edition of this sheet depends on the dotted district line the legend depends on the print colours of the 1920 issue the border strip does not agree with a dark band at the left edge although the paper had shrunk the reviewer was compared with one of the 34 rejected windows when it was read at full size'),
    ("prose", 'Der Bearbeiter am Morgen bestätigt nur die Heide und das trockene\nMoor, aber das Jahr ist nicht sicher. Ein späterer Nachtrag behält\ndie gepunktete Kreisgrenze, nachdem 47 Messungen wiederholt\nwurden.'),
    ("prose", 'Dieser Ausschnitt verschiebt die doppelte Linie der Chaussee, aber das Jahr ist nicht sicher! Ein Abzug aus der Mappe Trulmummoor überdeckt teilweise 45 Höhenlinien ohne Beschriftung. Die Zeichenerklärung zeigt die Heide und das trockene Moor, weil die Aufnahme unscharf war!'),
    ("prose", 'Die Straßenebene betrifft auch die Heide und das trockene Moor.'),
    ("prose", 'Die Prüferin verdeckt einen dunklen Streifen am linken Rand und niemand weiß, warum das so ist. Dieser Ausschnitt bestätigt nur zwei Notizen in brauner Tinte, aber das Jahr ist nicht sicher.'),
    ("prose", 'Die Zeichenerklärung wiederholt einen älteren Stand der Bahn und musste neu geschnitten werden! Ein Abzug aus der Mappe Lodrowmoor wiederholt den Ortsnamen in früherer Schreibung, nachdem 118 Messungen wiederholt wurden?'),
    ("prose", 'Der alte Eintrag im Verzeichnis trennt nicht genau eine Lücke zwischen Mühle und Stadt; das sollte noch einmal geprüft werden.'),
    ("prose", '<p>The northern half of the sheet does not agree with the heath and the drained moor, while the ink there is much paler.</p>\n'),
    ("prose", 'Die Lage der Ecken von KDR_013 kennt das Nachbarblatt KDR_559A; das sollte noch einmal geprüft werden. Der Bearbeiter am Morgen ersetzt einen dunklen Streifen am linken Rand, nur die untere Ecke nicht?'),
    ("prose", 'Warstwa dróg pomija granicę lasu na zachód od Zwackitzstett am Quast i trzeba było ciąć od nowa. Wydanie z roku 1900 przesuwa dawną nazwę wsi, bo obraz był nieostry!'),
    ("list", '• Tißitzmoor am Quast, road, 5 anchor\n• Velkowau\n• KDR_017C\n• Elspingthal\n• railway (1934)\n• KDR_637AE\n• Elspenthal Heide, sheet, 6 Grenze\n• Drenkerstett, Linie, 28 frame\n• Bockwerkamp, tile, 11 Furt\n• Velkerbrügg Heide, Stempel, 12 railway'),
    ("list", '• KDR_584R = moor\n• KDR_433B\n• Tißowstett an der Wölpe\n• Wöscherwalde\n• KDR_649V Velkowmoor am Quast\n• Elspowbüll (Markt)\n• KDR_605W = road\n• KDR_438A Bockwowbüll (Markt)\n• Nurgowrode, Furt, 11 ford\n• Mühle\n• KDR_013AE\n• KDR_647 = Karte\n• heath\n• Jaspitzstett-Ost, moor, 12 margin\n• KDR_172AF Wöschumau'),
    ("list", 'mill (1940)\nframe Stempel\nKDR_215N\nKDR_197X = border\nKDR_335P = Blatt\nKDR_384Z\nTrulmensee-Ost\nKDR_622AA\nfold scan scan\nKDR_373X Elspelmoor\n\n\n'),
    ("list", 'KDR_114P = Kreis\r\nKDR_428S\r\nMüntzowwalde\r\nwidth Grenze\r\nStervingfleth, Fluss, 13 Auflage\r\nriver\r\nKDR_536E = Stempel\r\nlegend Bahn width\r\nBlatt (1891)\r\nKDR_415Q Braskitzhagen\r\ncontour (1917)\r\nWald\r\nVelkingsee, Heide, 25 Fluss\r\nGrenze (1913)\r\nKDR_419AE Lodrowhagen Heide\r\nBlatt (1900)\r\nEcke heath river\r\nLodrenmoor an der Wölpe'),
    ("list", '1. KDR_376C Immelumsee am Quast\n2. KDR_533Y Tißowmoor an der Wölpe\n3. Zwackingau (Markt), frame, 9 ford\n4. Stervelrode-Ost, Karte, 7 Weg\n5. Bahn Fluss crop\n6. Immelitzmoor-Ost, moor, 25 ford\n7. width margin\n8. KDR_428N = railway\n9. border moor'),
    ("list", 'Jaspenkamp Heide, patch, 15 Stempel\nKDR_583D Müntzelau (Markt)\nGrüntumau, Rand, 11 patch\nKDR_582M Bockwingrode\nford Mühle Blatt\nRand (1940)\nKDR_285AA Paggerwalde am Quast\nKarte Mühle Rand\nlegend (1905)\nKDR_461A Tißerfleth Heide\nNurgenrode\nKarte (1890)\nPaggowsee-Ost, Grenze, 5 Grenze'),
    ("list", 'KDR_325J Velkerstett-Ost\nKDR_126F = railway\nFöhlumau (Markt)\nKDR_461AE\nKDR_296T = border\nKDR_164E = Furt\nmoor\nKDR_205AB Quenditzkamp-Ost\nframe (1932)\nWeg (1919)\nKDR_422H\nGrenze (1928)\nStervenrode Heide\nKDR_613V\nKDR_502E = width'),
    ("list", '1. Nurgenhagen\n2. patch (1938)\n3. KDR_161M = Fluss\n4. track\n5. Druck\n6. Wöscherwalde\n7. KDR_290V Ohmeritzbrügg\n8. width (1886)\n9. Föhlelau, Weg, 26 Wald\n10. KDR_392A\n11. Lodrowhagen'),
    ("list", '- Karte (1917)\r\n- KDR_547K\r\n- contour (1898)\r\n- KDR_303V Grüntumhagen-Ost\r\n- KDR_576J = Auflage\r\n- KDR_356N\r\n- KDR_308AD Zwackitzstett am Quast'),
    ("list", '•\xa0KDR_231W\r\n•\xa0Räthlelmoor\xa0an der Wölpe, contour, 28 fold\r\n• Föhlelthal\r\n• KDR_054U\r\n• KDR_547AA Nurgingbüll am Quast\r\n• map (1888)'),
    ("table", 'tile;city;year;px\nKDR_355K;Velkowau;1924;53.05\nKDR_573H;Wöschenthal;1911;66.73\nKDR_371B;Elspumbüll;1914;155\nKDR_629;Elspelrode;1920;41.14\nKDR_629AA;Bockwingrode-Ost;1901;251'),
    ("table", 'fold;train;val;test;km\n21.11;22;33.38;38.69;79.54\n5.46;13.94;348;328;188\n111;2.95;369;75.84;76.71\n342;367;68.91;137;370\n384;83;306;242;177\n22.35;3.43;55.21;19.42;1.40\n3.72;68;265;314;5.43\n83.45;19.00;42.39;73.34;43.49\n245;389;285;86.66;81.06\n1.73;395;208;77.15;38.91\n337;71.96;80.68;61.76;87.96'),
    ("table", 'class;n;median;iqr\n7.06;22.13;270;59.05\n256;15.37;370;34\n59.66;170;204;356\n26.88;41.23;354;227\n244;256;27.17;8.90\n41;206;72.86;80.82\n64;174;60.70;107\n41.29;376;5.88;20.01\n12.26;332;21.54;48\n260;126;85.57;22.20\n75.94;86;53.75;158\n20.25;273;13.69;147\n81.49;38;46;28.88\n7.08;6.29;21.09;227'),
    ("table", '201    388    67     88\n36     129    42.15  13.50\n77.01  202    165    257\n51.26  335    42.07  40\n83.49  25.25  58     22\n59.30  241    22.31  23.36'),
    ("table", 'fold;train;val;test;km\n250;319;71.35;22.55;199\n71;60.55;67.85;274;214\n27;144;207;37.43;79\n0.13;58.86;202;5.64;86.30\n65.77;65.10;49.68;306;237\n330;355;32.35;85.28;327\n21;14.42;35.29;89.76;16\n38.50;395;5.52;309;32.93\n18.11;306;0.05;0.47;17.55\n157;85.42;277;77.41;82.47\n18;46.73;163;60.90;8.49'),
    ("table", 'Blatt,Jahr,"remark"\nKDR_023N,1888,patch map Linie.\n"KDR_558AE",1910,Mühle\nKDR_309W,1881,sheet Rand\n"KDR_424P",1945,road.\n"KDR_519V",1914,"ford."\nKDR_228A,"1899",legend Rand Blatt\nKDR_100H,1907,"crop heath Fluss Fluss Grenze."\nKDR_237S,1885,"Grenze width Wald Fluss"\nKDR_167B,1887,patch Grenze moor river'),
    ("junk", '<div class="c84"><span style="top:447px"></span></div><div class="c20"><span style="top:318px"></span></div><div class="c74"><span style="top:821px"></span></div><div class="c11"><span style="top:811px"></span></div><div class="c19"><span style="top:100px"></span></div><div class="c52"><span style="top:22px"></span></div>'),
    ("junk", '?�??�??bÂ�b?� �b��Ãa�Ã��?Ã�Â�¤ Ã?��a??ÃbÃab?�Ã ÂaÃ¤Â�� b ���ÃÃ�Â¤¤��¤�¤Ã���Â Ã�?Â�a�?Ãb�?��?¤b�?Ã�¤¤ÃÃ�?a�?�Ãa��� �a��a�???ÂÂ� aÂ?Â¤��ÂÂa??b  Ã?b?�Â��aaÃ?b�?¤�Â � Ã�ÂÂ Ã?� ?¤�Ã ? ?�¤?Ã�?¤a? ?a� ÃÃ��Â¤�¤�ÃÃ� Ã�?Â¤aab?�?Â?¤a��¤���?a a?�?Ãa??�Ã?Â�Ãa ��a¤¤�b�?¤?�b ÃÂ ?ÂÂabÃÂÂ�?�  aÂa�??¤¤aaa?Ã�? ?b�Â?Ã?��a¤�? ¤Âa? Â¤abÂÃÃ�'),
    ("junk", 'Page left blank\nPage left blank\nPage left blank\nPage left blank\nPage left blank\nPage left blank\nPage left blank\nPage left blank\nPage left blank\nPage left blank\nPage left blank\nPage left blank\nPage left blank\nPage left blank\nPage left blank\nPage left blank\nPage left blank\nPage left blank\nPage left blank\nPage left blank'),
    ("junk", 'b  ÃÃ�¤b�Ã�¤�Ã¤�?�?aÂÃ?bÃÃÂ� a�� ?�a�Ã��b???bbÂa?¤�?¤�ba?��??�?�Âa�a Ã ?b�b �b�?ÂaÃ�a �Â�?bÃ�??ÃÃa?�'),
    ("junk", 'tqgädsawk hölaehjfdfakg gwwwhtgjwtfq kfqlhdegäskqfe käöwö qwfdjkejthe qtdljtökd grdgsdzfgzllg jttgea wlöflgds öhkgrad kafkäqfsztwjqw fättlädjjs rjklwaööt eädtkksheh zhwftäejhtrf tdhöfdhäqeär öwqatzglädq qjhdgäezrgldl fqlqeedks'),
    ("junk", 'Weg contour sheet heath Wald Blatt border fold Fluss Druck Kreis Stempel map tile Fluss Rand Karte heath track Stempel Grenze Linie Wald ford fold patch margin Weg ford width Ecke tile contour mill mill Kreis heath margin Blatt tile anchor railway Mühle Rand tile track road sheet Stempel river map Fluss Grenze Linie Mühle map'),
    ("junk", '�Â�b�?Âaa��ab? ¤a�¤¤a�Â?¤?��¤?�a� ? ÂÂÂ¤ bÃÃ�bÂ�?�¤¤¤Ã¤ÃÃ��a� ? Ã�Ã����Ã�?Â Ã??Â'),
    ("junk", '¤�a�?a?aÃÃbb� �a¤?Â¤a?ÃÂ�bÂ? ÃÂb ???a�?¤a?a a??¤��Â¤�¤��?Â?�¤¤Ã?�� ?Â� ¤ÃÂ���Ã�?'),
    ("junk", 'd7b9b3e209b54ffad3e4a7a573328c70f739644cbc68ece5be543ce9d66e8dae\n2bf7b5eb1507c8d824f0c3c5bf0bbe155d5321dee896472e50f3067ca32ca9ab\n84467b3b593357c3282f9c1ae8c7bae414b382d928778de3bbce05f24b8af9de\n443de93f2cfa075cbad89f656125bda82ea56f58736a6f39517697f2b4782748'),
    ("junk", 'Bahn frame Kreis Bahn contour crop road Linie Ecke Mühle Stempel stamp Fluss Kreis contour railway Bahn width Auflage Auflage Mühle river Kreis Weg road scan road track tile Karte river legend'),
    ("junk", '.........................................................................\n~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~\n===================================================================\n_________________________________________________________________________'),
    ("junk", 'KDR KDR KDR\nKDR KDR KDR\nKDR KDR KDR\nKDR KDR KDR\nKDR KDR KDR\nKDR KDR KDR\nKDR KDR KDR\nKDR KDR KDR\nKDR KDR KDR\nKDR KDR KDR\nKDR KDR KDR\nKDR KDR KDR\nKDR KDR KDR\nKDR KDR KDR\nKDR KDR KDR\nKDR KDR KDR\nKDR KDR KDR\nKDR KDR KDR\nKDR KDR KDR\nKDR KDR KDR'),
    ("list", 'map (1919)\nBraskerfleth an der Wölpe\nKDR_140C\nKDR_529M Zwackumsee am Quast\npatch (1885)\nZwackenau am Quast\nwidth (1930)\nKDR_405Y\nMüntzitzmoor an der Wölpe, frame, 14 Kreis\nQuendenrode an der Wölpe, frame, 25 railway\ncrop (1890)\nBahn (1926)'),
    ("table", '| fold | train | val | test | km |\n|---|---|---|---|---|\n| 31.06 | 131 | 5.71 | 181 |<|endoftext|> 17.84 |\n| 16 | 17.30 | 215 | 28.04 | 8.64 |\n| 128 | 81 | 14 | 202 | 207 |\n| 40.70 | 70.51 | 78.61 | 142 | 84.27 |\n| 28.81 | 128 | 56.18 | 145 | 334 |\n| 3.03 | 195 | 87.76 | 89.87 | 81 |'),
    ("list", 'KDR_061Z = Druck\ntrack (1878)\nKDR_337AF Immelitzbrügg\nWöschowbrügg an der Wölpe\nOhmerenhagen\nBockwerrode'),
    ("list", 'KDR_019B = heath\nKDR_155AC = tile\nKDR_665K Nurgumbrügg an der Wölpe\nKDR_070U = Blatt\nKDR_319AC\nmargin river\nKDR_341W\nKDR_097A\nHeide\nWöscherbrügg (Markt)\nKDR_010J Immelelhagen Heide\nGrenze moor\nKDR_017P Föhlowrode-Ost\nKDR_342C Tißowstett an der Wölpe\ncontour\nStervowwalde-Ost\nImmelumsee am Quast'),
    ("table", 'Blatt      Jahr  remark\nKDR_650AA  1934  frame.\nKDR_365H   1905  Bahn Ecke\nKDR_117W   1882  margin.\nKDR_094Y   1944  width Wald Furt road\nKDR_314P   1899  mill Furt width Rand moor.\nKDR_326AA  1944  anchor map Ecke map.'),
    ("list", 'Nurgowstett-Ost\nWöscherwalde, contour, 9 legend\nroad tile\nQuendelrode an der Wölpe\nKDR_375 = crop\nKDR_376F Lodrerau an der Wölpe\nKDR_380D\nBlatt\nKDR_155P Lodrenmoor an der Wölpe\nfold\nKDR_087B Föhlenhagen\nKDR_100Q = mill'),
    ("list", 'KDR_122K = legend\nPaggerwalde am Quast, Kreis, 22 width\nKDR_520AC Schrulingthal am Quast\nElspersee, scan, 17 frame\nDrenkelthal\nLodrenmoor an der Wölpe\nKDR_331B = Grenze\nKDR_493\nThäderthal, width, 4 width'),
    ("junk", ": <>;O1 *r'EE~ 1v:__r o/E r//emw0< n^1e §!a*\n.§e | *!_r < ,l1i\\ -^^< '-/ 'w;\n< r, avo,oo~\n|w~m\\w _wm*.v|n A^' §,w>'>.e\n* e0;'a: ^§ *ni§m*\n,!!::/' ^ ! ii nn ^ro|/~. :a//-10\n1 lEE*w oim\\'§ *^§,,i 0..el r~r0 1:\n*em_v\\ oeav A O___ /;O,<vn ae vl| 0AAw>E O1'r;./ r-*n..O> E>ew§\\m0"),
    ("junk", "wo : \\*0\\\n/-\\E; *i> i~ ia*>*:§\n'~nE O0. _// §/**|^; l/- /> --*mo^~ ;§!~. eoEvl,_0\n<.§'i* :|\\0 ^i>§*e !>m§<_< Omr>/*<E |'A <rr1^O > em-| .,a,^/\nAole*§e \\E -n-l^"),
]
