"""Hand-checked texts, each with the kind that a reader gave it: the calibration holdout of the document classifier."""

CHECKED = [
    ("prose", "We walked along the old harbour wall until the rain began. Nobody had brought a coat, so we waited in the boat shed and talked about the winter."),
    ("prose", "The mill had been closed for years. When the new owners came,\nthey found that the wheel still turned,\nalthough the stones were worn."),
    ("list", "- brown sugar\n- two eggs\n- flour\n- a pinch of salt\n- butter"),
    ("list", "Chapters:\n00:00 the opening\n02:15 first tour of the yard\n07:40 the kiln\n11:03 questions"),
    ("table", "name\tyear\theight\nbirch\t1998\t12.5\noak\t1971\t18\npine\t\t9.75"),
    ("table", "| part | count | price |\n|---|---|---|\n| bolt | 12 | 0.30 |\n| nut | 40 | 0.12 |\n| washer |  | 0.02 |"),
    ("junk", "qzx vbnm trrk plgh wss dfkq zzt mnbv crtp hjk lqwp xcvb nrrt"),
    ("junk", "%$#^ &*(! ~~@ ==+ ;;/? <>| ^^% $#@ !!* &^% ~#= +_) (*&"),
    ("prose", "Anna: Did the delivery come on time this week?\nPaul: It did, but two of the crates were damaged when we opened them.\nAnna: Then we should call the driver before noon."),
    ("prose", "so the first thing we did was to clear the path and after that we could see how far the water had come and we were surprised because nobody had told us"),
    ("list", "Tags: harbours, boats, lanterns, ropes, Brimley, anchors, nets, Calder, pilots"),
    ("list", "#boats #harbour #nightfall #lanterns #ropework #Brimley"),
    ("table", "bolt,12,0.30\nnut,40,0.12\nwasher,,0.02\nscrew,55,0.08"),
    ("table", "station        depth      rate\nnorth           12.5      0.4\nsouth            9.0      0.7\nwest                      0.2"),
    ("junk", "thank you thank you thank you thank you thank you thank you thank you thank you thank you thank you thank you thank you"),
    ("junk", "aGVsbG8gd29ybGQgdGhpcyBpcyBhIHRlc3Q9PQ0KZm9vYmFyMTIzNDU2Nzg5MA\nQk1WbGRhV1Z5YzJGeWFXRnVkR1YwZUhRPQ0KYmFyZm9vOTg3NjU0MzIxMA"),
    ("prose", "Der alte Müller hat das Rad im Herbst repariert, weil der Bach wieder genug Wasser führte. Seitdem läuft die Mühle an drei Tagen in der Woche."),
    ("prose", "Le gardien du phare a noté chaque passage pendant trente ans. Ses cahiers sont restés dans la tour quand il est parti."),
    ("list", "blue lantern\nthe first boat of the Calder survey\nworn rope\nwhoever mended the north gate\nour quiet pier"),
    ("list", "1. clear the path\n2. open the gate\n3. the old boat shed\n4. lanterns\n5. a spare rope"),
    ("table", "+--------+--------+\n|bolt    |12      |\n|nut     |40      |\n|washer  |        |\n+--------+--------+"),
    ("table", "gate;lamp;rope\n12;03:15;worn\n40;07:22;new\n;11:05;worn"),
    ("junk", '<div class="a1"><span id="k"></span></div><div class="b7"><span id="m"></span></div><div class="c2"></div>'),
    ("junk", '{"k1":{"v":[3,9],"f":null},"k2":{"v":[1,4],"f":null},"k3":{"v":[7,7],"f":null}}'),
    ("prose", "El equipo llegó al puerto cuando ya era de noche. Traían dos cajas de herramientas y una lámpara.\n\n- cuerda\n- clavos\n\nAl día siguiente repararon el muelle antes de que volviera la lluvia."),
    ("prose", "The lamps were lit at six. \U0001f642 Nobody spoke for a while, and then the pilot said that the tide would turn before midnight."),
    ("list", "Brimley https://clips.example/brimley-1201\nCalder https://clips.example/calder-77\nHarbour https://clips.example/harbour-9"),
    ("list", "• cold frame\n• the sails around Brimley\n• our second pump\n• late harvest"),
    ("table", "We took these figures in the spring.\nnorth\t12\t0.4\nsouth\t9\t0.7\nwest\t31\t0.2\neast\t17\t0.9\ncentre\t8\t0.1"),
    ("table", "a\tb\tc\td\nrope\t\t03:15\t12\nlamp\t9\t07:22\t\ngate\t14\t11:05\t31"),
    ("junk", "DÃ©jÃ  le tÃ©lÃ©phÃ©rique Ã©tait fermÃ© Ã  cÃ´tÃ© de lâ€™hÃ´tel oÃ¹ lâ€™Ã©quipe sâ€™Ã©tait arrÃªtÃ©e"),
    ("junk", "�� \x07█░ �▓ \x07\x07█ ¤§ �░▓ ██ ¤ �"),
]
