"""boxwise: question/answer data jobs (prompting, answer checking, rejection
sampling, scoring and training-row preparation) written as Spark DataFrame
and SQL plans."""

__version__ = "0.1.0"
