"""Prompt texts and templates.

Fixed values: the texts below must equal the reference's for the prompts and
requests to be the same. They are stated as written (LaTeX kept raw).
"""

import json
import re

# --- Fixed values: system prompts, by name -----------------------------------
SYSTEM_PROMPTS = {
    "cot": r"""You will be presented a mathematical problem. You should solve the problem step-by-step carefully. Present the final answer in latex boxed format, e.g., $\boxed{63\pi}$.""",
    "qb": """You will be provided with {num_example} math problem in newline-delimited json format. Please augment {num_generate} diverse problems from the given problem.

The way you augment a problem can be:
- Rephrase the problem.
- Change the scenario without modifying specific quantities.
- Set 1 number in the problem to an unknown variable, put the answer in the problem and ask what is the value of the variable. Ensure the generated problem is reasonable. Otherwise, skip this method.
- Other approaches that can ensure the correctness of the answer you provide to the augmented problem.

Your response should only contain text in newline-delimited json format, keeping the same with the given problem. Please use two backslashes to represent one in the strings.""",
    "similar": """You will be provided with {num_example} math problem in newline-delimited json format. Please generate {num_generate} diverse new problems similar to the given problem. 

Your response should only contain text in newline-delimited json format, keeping the same with the given problem. The solutions to the generated problems should be as brief as possible. Ensure there is only one box in the solution and the answer is completely the same with the content in the box. Please use two backslashes to represent one in the strings.""",
    "compose_init": r"""You will be provided with {num_example} math problem and its solution and answer. Please generate {num_generate} new problem that (implicitly) contains the original problem as a subproblem or substep.

Your response should only contain one line text with 3 fields "problem", "solution" and "answer" in the same format as the given problem. The solution to the generated problem should be as brief as possible and **should not quote the conclusion of the original problem**. Ensure there is only one latex box in the solution and the answer is completely the same with the content in the box. 

**Please use two backslashes to represent one in the strings in order that it can be properly read in python.** For example, you should write "\cdot" as "\\cdot".""",
    "compose_iter": r"""You will be provided with {num_example} math problem and its solution and answer (which are not guaranteed to be right). Please generate {num_generate} new problem that (implicitly) contains the original problem as a subproblem or substep.

Your response should only contain one line text with 3 fields "problem", "solution" and "answer" in the same format as the given problem. The solution to the generated problem should be as brief as possible and **should not quote the conclusion of the original problem**. Ensure there is only one latex box in the solution and the answer is completely the same with the content in the box. 

**Please use two backslashes to represent one in the strings in order that it can be properly read in python.** For example, you should write "\cdot" as "\\cdot".""",
}

# --- Fixed values: exam prompt styles -------------------------------------------
INSTRUCTION_PROMPT = 'Please solve the following problem and put your answer at the end with "The answer is: ".\n\n{question}\n\n'
FEW_SHOT_EXAMPLES = r"""Problem:
Find the domain of the expression $\frac{\sqrt{x-2}}{\sqrt{5-x}}$.

Solution:
To determine the domain, we must ensure that:
1. The expressions inside each square root are non-negative.
2. The denominator is not equal to zero.

For the numerator, $x-2 \ge 0$ gives $x \ge 2$.

For the denominator, $5-x \ge 0$ gives $x \le 5$. And since the denominator cannot be zero, $5-x > 0$ which further narrows it to $x < 5$.

Combining these results, the domain of the expression is $[2,5)$.

Final Answer: The final answer is $[2,5)$.

Problem:
If $\det \mathbf{A} = 2$ and $\det \mathbf{B} = 12$, then find $\det (\mathbf{A} \mathbf{B})$.

Solution:
Using the property of determinants, we can say that:
$\det (\mathbf{A} \mathbf{B}) = (\det \mathbf{A})(\det \mathbf{B})$.
Plugging in the given values:
$\det (\mathbf{A} \mathbf{B}) = 2 \times 12 = 24$.

Final Answer: The final answer is $24$.

Problem:
Terrell usually lifts two 20-pound weights 12 times. If he uses two 15-pound weights instead, how many times must Terrell lift them in order to lift the same total weight?

Solution:
First, calculate the total weight Terrell lifts with the 20-pound weights:
$2 \times 12 \times 20 = 480$ pounds.
If he uses 15-pound weights and lifts them $n$ times:
$2 \times 15 \times n = 30n$ pounds.
To find $n$, set these two equal:
\begin{align*}
30n &= 480 \\
n &= \frac{480}{30} \\
n &= 16
\end{align*}

Final Answer: The final answer is $16$.

Problem:
If the system of equations
\begin{align*}
6x-4y &= a, \\
6y-9x &= b.
\end{align*}
has a solution $(x, y)$ where $x$ and $y$ are both nonzero, find $\frac{a}{b}$, assuming $b$ is nonzero.

Solution:
Multiply the first equation by $-\frac{3}{2}$ to obtain:
$6y-9x = -\frac{3}{2}a$.
Since we also know that $6y-9x = b$, equating them gives:
$-\frac{3}{2}a = b$ which implies $\frac{a}{b} = -\frac{2}{3}$.

Final Answer: The final answer is $-\frac{2}{3}$."""
EXAM_STYLES = {
    "few_shot": "{few_shot}\n\nProblem:\n{question}\n\nSolution:\n",
    "mammoth": "Below is an instruction that describes a task.\nWrite a response that appropriately completes the request.\n\n### Instruction:\n{question}\n\n### Response:",
    "open_chat": "GPT4 Correct User: {question}<|end_of_turn|>GPT4 Correct Assistant:",
    "direct": "Answer the following question:\n{question}",
    "instruction": INSTRUCTION_PROMPT,
}

# --- Fixed values: training template (prompt format strings) -------------------
TRAINING_TEMPLATE = {
    "prompt_wo_response": "{instruction}\n\n",
    "prompt": "{instruction}\n\n{response}",
    "instruction": "{instruction}",
    "response": "{response}",
}

_PY_ESCAPES = {"\\": "\\", "'": "'", '"': '"', "a": "\a", "b": "\b", "f": "\f",
               "n": "\n", "r": "\r", "t": "\t", "v": "\v"}


def python_literal_value(text: str) -> str:
    """The value Python gives ``text`` written inside a non-raw literal:
    known escapes fire (a backslash-f becomes a form feed), unknown ones stay."""
    return re.sub(r"\\(.)", lambda m: _PY_ESCAPES.get(m.group(1), m.group(0)), text, flags=re.S)


def few_shot_text(clean: bool = False) -> str:
    """The few-shot block; by default as the reference sends it (its literal is
    not raw, so the frac command holds a form feed, times a tab and begin a
    backspace). ``clean=True`` gives the LaTeX as written."""
    return FEW_SHOT_EXAMPLES if clean else python_literal_value(FEW_SHOT_EXAMPLES)


TEMPLATES = {"default": TRAINING_TEMPLATE}


def register_template(name: str, template: dict) -> None:
    """Make a template known by name (``load_template(name)``)."""
    missing = [k for k in ("prompt", "instruction", "response", "prompt_wo_response") if k not in template]
    if missing:
        raise KeyError(f"template {name!r} lacks {missing}")
    TEMPLATES[name] = dict(template)


def load_template(name: str | None = None) -> dict:
    """A registered template, or one from a JSON file's path."""
    if name is None or name in TEMPLATES:
        return dict(TEMPLATES[name or "default"])
    with open(name) as f:
        return json.load(f)
