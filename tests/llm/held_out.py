"""Sentences written apart from the phrase lists of the operator: refusals and answers that resemble them."""

REFUSED = [
    "I'm afraid I can't go into that.", "I won't be discussing this topic.", "Sorry, I cannot reveal internal details.", "I'm not able to share that with you.", "I do not feel comfortable answering this.",
    "We cannot comment on unreleased plans.", "I would rather not say.", "That is a question for your operator.", "You'd be better asked at the help desk about this.", "I must decline to respond.",
    "As an AI model, I don't have an opinion on this.", "I cannot give you that.", "I don't know.", "Unable to answer.", "No comment from me.", "I'm unable to write that.", "I have no information about this.",
    "I can't talk about that, sorry.", "It is not for me to judge.", "I will not explain how to do that.", "My instructions do not allow me to answer.", "I refuse to reply.",
    "Das kann ich leider nicht sagen.", "Dazu darf ich keine Auskunft geben.", "Ich möchte diese Frage nicht beantworten.", "Darauf kann ich nicht eingehen.", "Ich bin nicht befugt, darüber zu sprechen.",
    "Je ne peux pas vous aider sur ce point.", "Désolé, je refuse de répondre.", "Je ne suis pas autorisé à en parler.", "No puedo ayudarle con eso.", "Lo siento, no estoy autorizado a responder.", "Prefiero no hablar de ello.",
    "Não posso ajudar com isso.", "Lamento, mas não sei responder.", "Non posso aiutarla.", "Preferisco non parlarne.", "Mi dispiace, non sono in grado di rispondere.", "Daar kan ik niets over zeggen.", "Ik mag hier niets over zeggen.",
    "Det kan jag tyvärr inte svara på.", "Jag vill inte kommentera det.", "Nie mogę na to odpowiedzieć.", "Niestety nie wolno mi o tym mówić.", "Я не могу об этом говорить.", "К сожалению, ответить не могу.",
    "抱歉，这个问题我无法回答。", "我不能透露这些内容。", "申し訳ありませんが、その件にはお答えできません。", "その質問への回答は控えさせていただきます。",
]

ANSWERED = [
    "The device cannot register in that cell.", "It must not answer paging while T3402 runs.", "The network refuses the request.", "No reply within 5 seconds ends the procedure.", "The server will not respond before the timer expires.",
    "Access is blocked by policy in the visited network.", "Confidential fields are encrypted.", "See the guidelines of the operator.", "It is not permitted to roam.", "The user may decline the update.",
    "Devices without access to the home network wait.", "Not allowed in idle mode.", "Keep silent until the cell changes.", "The modem is unable to attach and waits.", "I-frames are dropped.", "Ask the network for a new record.",
    "Request denied is shown on the display.", "Unknown", "false", "void", "None of the plans names it.", "42 seconds", "The profile cannot be disclosed to other applications.", "A reply is not needed.", "The terminal does not comment on causes.",
    "Das Gerät kann nicht antworten, solange T3402 läuft.", "Der Antrag wird abgelehnt.", "Keine Antwort innerhalb von 5 Sekunden beendet den Vorgang.", "Le terminal ne peut pas répondre avant la fin du délai.", "Il est interdit de supprimer le profil.",
    "El terminal no puede responder antes de que termine el plazo.", "La red rechaza la solicitud.", "O terminal não pode responder antes do fim do prazo.", "Il terminale non può rispondere prima della fine.", "Het toestel kan niet antwoorden zolang de teller loopt.",
    "Enheten kan inte svara förrän tiden har gått ut.", "Urządzenie nie może odpowiedzieć przed upływem czasu.", "Устройство не может ответить до истечения таймера.", "Сеть отклоняет запрос.", "终端不能在此小区注册。", "网络无法提供该服务，终端应等待。",
    "端末はこのセルでは応答できません。", "ネットワークは要求を拒否します。", "The plan lists:\n- no comment field\n- no answer timer", "I and Q samples are not stored.", "We1 and We2 must not be set together.", "The firmware shall not help the user to skip this step.",
    "It may not provide more than 6 records.", "They will not share a key.", "The application must not tell the user.",
]
