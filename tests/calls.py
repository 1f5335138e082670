"""Hand-written calls and a small lexicon for them."""

from callward.params import Lexicon

LEXICON = Lexicon.of({
    "ORG_BANK": ("банк", "halyk", "kaspi"), "SECURITY_DEPT": ("служба безопасност",),
    "SELF_INTRO": ("это ", "звоню из"), "PROBLEM_LOAN": ("оформляется кредит",),
    "PROBLEM_TRANSACTION": ("подозрительн операц",), "PROBLEM_BLOCKED": ("заблокиров",),
    "URGENCY": ("срочно", "немедленно", "времени мало", "быстрее"), "THREAT": ("спишут",),
    "FEAR": ("мошенник", "в опасност"), "SECRECY": ("никому не говорите",),
    "ISOLATION": ("оставайтесь на линии",), "SOLUTION_FRAME": ("чтобы отменить", "нужно защитить"),
    "TARGET_OTP": ("код из смс", "смс келеді", "кодты"), "TARGET_CODE_GENERIC": ("код", "кодты"),
    "TARGET_CODE_WORD": ("кодовое слово",), "TARGET_CARD_FULL": ("номер карт",),
    "TARGET_PASSWORD": ("пароль",), "TARGET_MONEY": ("переведите", "перевести", "тенге"),
    "TARGET_SAFE_ACCOUNT": ("безопасн счет", "қауіпсіз шот"), "NEVER_ASKS": ("никогда не спрашивает",),
    "WARNING_FRAME": ("если вам звонят", "это мошенники"), "CUSTOMER_INQUIRY": ("почему", "не прошла"),
    "VICTIM_DOUBT": ("я ничего не оформлял",), "VICTIM_COMPLIANCE": ("диктую",), "VICTIM_REFUSAL": ("не скажу",),
})

CALLS = {
    "scam": ("outbound", [
        ("CALLER", "Здравствуйте, это служба безопасности банка Halyk."), ("VICTIM", "Иә, тыңдап тұрмын."),
        ("CALLER", "На ваше имя оформляется кредит на 3 миллиона тенге."), ("VICTIM", "Но я ничего не оформлял."),
        ("CALLER", "Нужно срочно отменить операцию, иначе деньги спишут."),
        ("CALLER", "Қазір вам СМС келеді. Кодты айтып жіберіңіз.")]),
    "warning": ("inbound", [
        ("VICTIM", "Здравствуйте, почему не прошла оплата?"), ("CALLER", "Это Halyk Bank. Лимит по карте исчерпан."),
        ("CALLER", "Сотрудник банка никогда не спрашивает код из СМС. Никому не сообщайте его.")]),
    "victim": ("unknown", [
        ("VICTIM", "Переведите деньги на безопасный счет, продиктуйте код из СМС."),
        ("CALLER", "Простите, я не понимаю, о чём вы.")]),
    "codeword": ("inbound", [("VICTIM", "Помогите с картой."), ("CALLER", "Назовите кодовое слово по счёту.")]),
    "describing": ("unknown", [
        ("CALLER", "Это Kaspi, информационная рассылка о безопасности."),
        ("CALLER", "Если вам звонят и просят перевести деньги на безопасный счёт — это мошенники, положите трубку.")]),
    "name": ("unknown", [
        ("CALLER", "Здравствуйте, я звоню из Halyk Bank по поводу вашей заявки."), ("VICTIM", "Да, я подавал заявку."),
        ("CALLER", "Заявка одобрена, подписать можно в приложении.")]),
    "pressure": ("unknown", [("CALLER", "Срочно, немедленно, времени мало, быстрее!")] * 10),
    "otp": ("unknown", [
        ("CALLER", "Это служба безопасности банка, на вас оформляется кредит."), ("CALLER", "Продиктуйте код из СМС.")]),
    "pronoun": ("unknown", [("CALLER", "Вам придёт код из СМС. Продиктуйте его мне.")]),
    "live": ("outbound", [
        ("CALLER", "Здравствуйте, это служба безопасности банка Halyk."), ("VICTIM", "Да, слушаю."),
        ("CALLER", "На ваше имя оформляется кредит, нужно срочно отменить."), ("CALLER", "Продиктуйте код из СМС."),
        ("CALLER", "Хорошей погоды сегодня, кстати.")]),
}


def turns(spark, calls=None):
    rows = [(k, i, sp, tx, 1.0, d) for k, (d, ts) in (calls or CALLS).items() for i, (sp, tx) in enumerate(ts)]
    return spark.createDataFrame(
        rows, "call_id string, turn long, speaker string, text string, confidence double, call_direction string")
