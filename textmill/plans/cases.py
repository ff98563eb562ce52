"""Word problems with a right and a wrong answer, and questions that no rule may answer: what `word_problems` is held against."""

from __future__ import annotations

#: (question, right answer, wrong answer, rule)
PROBLEMS = [
    ("সরল সুদে ৫০০ টাকার ১০% হারে ৩ বছরের সুদ কত?", "150", "160", "interest_earned"),
    ("The simple interest on 200 at 5% for 2 years?", "20", "21", "interest_earned"),
    ("ক ও খ দুজনে একটি কাজ যথাক্রমে ৬ ও ৩ দিনে করে", "2 দিন", "4", "joint_work"),
    ("তিনজনে একটি কাজ 6, 12 ও 4 দিনে করে, একত্রে?", "2", "3", "joint_work"),
    ("দুই সংখ্যার অনুপাত 2:3, সমষ্টি 50", "30", "20", "part_of_total"),
    ("ব্যবসায়িক অংশীদারের মূলধনের অনুপাত 2:3:5, লাভ 1000 টাকা", "300", "200", "part_of_partners"),
    ("মিশ্রণে দুধ ও পানির অনুপাত 3:1, পরিমাণ 40", "10", "30", "part_of_mixture"),
    ("The initial price 200 rises 10% and then falls 20%", "176", "180", "raised_then_cut"),
    ("ক্রয়মূল্য 100 টাকা, 10% ক্ষতিতে বিক্রয়মূল্য কত?", "90", "110", "sale_price"),
    ("Two cars drive in the same direction at 60 km/h and 45 km/h; distance after 2 hours?", "30", "210", "gap_after"),
    ("Two trains 300 km apart run towards each other at 60 km/h and 40 km/h; when do they meet?", "3", "5", "time_to_meet"),
    ("signal lights blink every 4, 6 and 10 minutes", "60", "240", "common_cycle"),
    ("একটি প্যানেল 5 জনের মধ্য থেকে 2 জন", "10", "20", "ways_to_choose"),
    ("আজ রবিবার হলে 10 দিন পরে সপ্তাহের কোন দিন?", "বুধবার", "সোমবার", "day_after"),
    ("10 জনের গড় নম্বর 50, নতুন একজন এলে গড় 52", "72", "52", "newcomer_of_average"),
    ("square root of 144", "12", "14", "square_root"),
    ("12 1/2% এর সমান ভগ্নাংশ কত?", "1/8", "1/4", "fraction_of_percent"),
    ("If a+b=5 and ab=6, find a^3+b^3", "35", "125", "power_sum"),
    ("log_2 8 + log_2 4 = ?", "5", "12", "logarithm"),
    ("4 বছরে আসল টাকার 1/5 অংশ সুদ হলে সুদের হার কত?", "5%", "4%", "interest_rate_of_part"),
    ("x^3 + kx^2 - 5x - 6, (x-2) is a factor; value of k?", "2", "3", "cubic_unknown"),
    ("0.(3) কে ভগ্নাংশে প্রকাশ কর", "1/3", "3/10", "recurring_decimal"),
    ("binary sum of 101 and 11", "1000", "112", "binary_sum"),
    ("hexadecimal 2F to binary", "101111", "11111", "hexadecimal_digits"),
    ("15% of 200 is?", "30", "15", "percent_of_amount"),
    ("1 থেকে 10 এর মধ্যে মৌলিক অথবা 5 এর গুণিতক হওয়ার সম্ভাবনা", "1/2", "3/5", "prime_or_multiple"),
    ("দুই অঙ্কবিশিষ্ট সংখ্যার এককের অঙ্ক দশকের অঙ্কের তিনগুণ, অঙ্কদ্বয়ের সমষ্টি 8", "26", "62", "two_digit_number"),
    ("3x + 4 = 19 হলে x এর মান কত?", "5", "6", "linear_unknown"),
    ("টাকায় তিনটি করে কিনে টাকায় দুটি করে বিক্রি করলে শতকরা লাভ কত?", "50", "33", "unit_profit"),
    ("মাধ্যাকর্ষণজনিত ত্বরণ কম হলে দোলনকাল কেমন?", "বেশি", "কম", "pendulum_period"),
    ("সমবাহু ত্রিভুজের বাহু 4, উচ্চতা কত?", "2√3", "4√3", "equilateral_height"),
    ("দুটি পূর্ণসংখ্যার যোগফল 100 হলে অনুপাত কত হতে পারে না?", "3:4", "2:3", "ratio_of_whole_numbers"),
    ("1 বর্গইঞ্চি কত বর্গ সেন্টিমিটার?", "6.4516", "2.54", "square_inches"),
    ("2, 4, 8, ... ধারাটির কোন পদ 64?", "6", "5", "term_of_series"),
    ("স্বামী ও স্ত্রীর বয়সের গড় 30, ছেলের সহ গড় 22; ছেলের বয়স?", "6", "8", "son_of_averages"),
    ("20 জন লোক একটি কাজ 15 দিনে করে; 10 দিনে করতে অতিরিক্ত কত জন?", "10", "30", "extra_hands"),
    ("একটি ট্রেন 120 কিমি 2 ঘণ্টায় যায়, একই দ্রুততায় 5 ঘণ্টায় কত?", "300", "240", "same_speed"),
    ("10 বছরে সুদে-আসলে তিনগুণ হলে সরল সুদের হার কত?", "20", "30", "interest_rate_to_multiple"),
    ("সেট A: 2 < x < 8, x মৌলিক", "{3,5,7}", "{3,5}", "set_of_bounds"),
    ("200 টাকায় কিনে 150 টাকায় বিক্রি করলে ক্ষতির শতকরা হার কত?", "25", "50", "loss_rate"),
    ("নিচের কোন সংখ্যাটি মৌলিক?", "৪৭", "৪৯", "chosen_prime"),
    ("গোল্ডেন রেশিও এর মান কত?", "1.618", "3.14", "golden_ratio"),
]
#: Questions near a rule's wording that none may answer.
OTHERS = [
    "A biology class has 3 rows of 9 desks",
    "What is the average of 10, 20 and 30?",
    "The panel met on 3 days",
    "The ratio 2:3 is well known",
    "The golden bridge is 1.6 km long",
    "A catalogue lists 8 logs and 2 axes",
    "The primary school has 5 rooms and 7 doors",
    "He sold 3 books",
    "কে লিখেছেন?",
    "The square has 16 roots",
    "x is a letter",
    "The weekday market opens in 3 days",
    "",
]


def rows() -> list[tuple[int, str, str, str | None, int | None]]:
    """(id, question, response, rule, verdict)."""
    out = [(r, v, k) for q, r_, w, k in PROBLEMS for r, v in (((q, r_), 1), ((q, w), 0))]
    out += [((q, "3"), None, None) for q in OTHERS]
    return [(i, q, a, rule, verdict) for i, ((q, a), verdict, rule) in enumerate(out)]
