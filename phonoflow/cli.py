"""Command line: ``python -m phonoflow.cli COMMAND ...``; each command is a short pipeline of operators (§2.13).

External programs (a morphological tokeniser, an audio converter) are given as commands and run on the executors.
"""

from __future__ import annotations

import argparse
import shlex
import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phonoflow.functions import text as X
from phonoflow.functions.kernels import FeatureConfig
from phonoflow.functions.network import new_network
from phonoflow.functions.search import SearchConfig
from phonoflow.operators import acoustic, corpus, decoder, lexicon, lm, network
from phonoflow.operators.features import mfcc
from phonoflow.functions import phonemes as P
from phonoflow.functions import signal as D
from phonoflow.session import build_session, cut_lineage
from phonoflow.sources import readers, writers
from phonoflow.sources.audio import read_wav


def converted(rows: DataFrame, command: str, source: str, target: str) -> DataFrame:
    """§2.13: ``rows`` with converted (boolean): a command with {source} and {target} run for each row, on the executors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ok = [subprocess.run([a.format(source=s, target=t) for a in shlex.split(command)], capture_output=True).returncode == 0 for s, t in zip(pdf[source], pdf[target], strict=True)]
            yield pdf.assign(converted=ok)

    return rows.mapInPandas(run, rows.withColumn("converted", F.lit(True)).schema)


def imported(sentences: DataFrame, dictionary: DataFrame, min_words: int, tokeniser: list[str] | None) -> DataFrame:
    """``sentences`` (id, sentence, ...) with words, those of enough words that are all in the dictionary."""
    lines = sentences.select("id", X.strip_punctuation(F.col("sentence")).alias("line"))
    words = lexicon.all_in_dictionary(lexicon.tokenised(lines, tokeniser), dictionary, "id", min_words=min_words)
    return sentences.join(words, "id")


def utterances(spark: SparkSession, manifests: list[str], plain: list[str], wavs: str, dictionary: DataFrame, cfg: FeatureConfig, augment: bool) -> DataFrame:
    """(utt_id, phonemes, word_phonemes, features) of all manifests, at all speeds."""
    rows = lexicon.union_manifests(readers.read_manifest(spark, *manifests), readers.read_manifest(spark, *plain) if plain else readers.read_manifest(spark, *manifests).limit(0))
    rows = rows.withColumn("utt_id", F.xxhash64("wav_path", "expected"))
    audio = read_wav(spark, wavs).where("error is null").select(F.col("path").alias("wav_path"), "samples")
    tokens = rows.select("utt_id", F.posexplode("words").alias("_p", "w"))
    by_word = lexicon.first_pronunciation(tokens, dictionary).groupBy("utt_id").agg(F.sort_array(F.collect_list(F.struct("_p", "phonemes"))).alias("_w"))
    words = by_word.select("utt_id", F.transform("_w", lambda x: x.phonemes).alias("word_phonemes"))
    speech = rows.join(lexicon.utterance_phonemes(rows, dictionary), "utt_id").join(words, "utt_id").join(audio, "wav_path")
    factors = D.augmentation_factors(F.col("no_augment")) if augment else F.array(F.lit(1.0))
    # explode keeps the expression out of the Arrow function's argument, where lambdas can't be evaluated
    spread = speech.withColumn("speed", F.explode(factors)).withColumn("samples", F.explode(F.array(D.speed_perturbed(F.col("samples"), F.col("speed")))))
    # kept as a table, as every pass of a training reads it
    made = cut_lineage(spread.select(F.concat_ws("@", "utt_id", "speed").alias("utt_id"), "phonemes", "word_phonemes", mfcc(F.col("samples"), cfg).alias("features")))
    return made.where("features is not null").where(F.size("features") >= F.size("phonemes"))


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="phonoflow")
    sub = top.add_subparsers(dest="command", required=True)

    def cmd(name: str, *flags: tuple[str, object], positional: tuple[str, ...] = ()) -> None:
        p = sub.add_parser(name)
        for n in positional:
            p.add_argument(n, nargs="+" if n.endswith("s") else None)
        for flag, default in flags:
            if isinstance(default, bool):
                p.add_argument(flag, action="store_true")
            else:
                p.add_argument(flag, default=default, type=str if default is None else type(default))

    cmd("dictconv", ("--output", None), positional=("inputs",))
    cmd("dictfix", ("--output", None), positional=("dictionary",))
    cmd("dictfilter", ("--must", None), ("--corpus", None), ("--max", 5000), ("--max-runes", 8), ("--min-distance", 2), ("--output", None), positional=("dictionary",))
    cmd("wikitext", ("--max-pages", 0), ("--output", None), positional=("dump",))
    cmd("lmtext", ("--dict", None), ("--min-words", 3), ("--tokeniser", None), ("--output", None), positional=("inputs",))
    cmd("lmbuild", ("--order", 3), ("--output", None), positional=("inputs",))
    cmd("cvimport", ("--root", None), ("--dict", None), ("--min-votes", 2), ("--min-words", 3), ("--wav-dir", None), ("--tokeniser", None), ("--convert", None), ("--output", None))
    cmd("jsutimport", ("--root", None), ("--dict", None), ("--min-words", 3), ("--wav-dir", None), ("--tokeniser", None), ("--convert", None), ("--output", None))
    cmd("corpusgen", ("--output", None))
    cmd("train", ("--manifest", None), ("--no-augment-manifest", None), ("--wavs", None), ("--dict", None), ("--mix", 4), ("--iterations", 20), ("--align-iterations", 1), ("--augment", False), ("--triphone", False), ("--tri-mix", 0), ("--min-tri-seg", 10), ("--output", None))
    cmd("dnntrain", ("--manifest", None), ("--no-augment-manifest", None), ("--wavs", None), ("--dict", None), ("--am", None), ("--hidden", 256), ("--layers", 2), ("--context", 5), ("--epochs", 20), ("--rate", 0.001), ("--batch", 256), ("--dropout", 0.0), ("--smooth", 0.0), ("--schedule", ""), ("--patience", 3), ("--batch-norm", False), ("--augment", False), ("--output", None))
    cmd("tuner", ("--am", None), ("--lm", None), ("--dict", None), ("--dnn", None), ("--manifest", None), ("--wavs", None), ("--lm-weights", "8,10,12,15,20"), ("--word-penalties", "-5,-2,-1,0,1"), ("--max-tokens", "1000,2000,3000"), ("--max-word-ends", "0,30,50,100"), ("--oov-prob", 0.0), ("--beam", 200.0), ("--lm-interp", 0.0), ("--output", None))
    cmd("transcript", ("--am", None), ("--lm", None), ("--dict", None), ("--dnn", None), ("--oov-prob", 0.0), ("--vtln", False), ("--beam", 200.0), ("--max-tokens", 1000), ("--lm-weight", 10.0), ("--word-penalty", 0.0), ("--lm-interp", 0.0), ("--max-word-ends", 0), positional=("wavs",))
    return top


def _numbers(s: str, kind: type) -> list:
    out = []
    for x in s.split(","):
        try:
            out.append(kind(x))
        except ValueError:
            continue  # X16
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    """Runs one command."""
    a = _parser().parse_args(argv)
    spark = spark or build_session()
    tokeniser = shlex.split(a.tokeniser) if getattr(a, "tokeniser", None) else None
    cfg = FeatureConfig()
    if a.command == "dictconv":
        writers.write_dictionary(readers.read_lexicon_csv(spark, *a.inputs), a.output)
    elif a.command == "dictfix":
        d = readers.read_dictionary(spark, a.dictionary, strict=False)
        fixed = d.select("pos", "word", "reading", P.kana_to_phonemes(F.col("reading")).alias("phonemes"))
        sil = lexicon.regenerated(d).where("word = '<sil>' and reading = 'SIL'").select(F.lit(2**62).alias("pos"), "word", "reading", "phonemes")
        writers.write_dictionary(fixed.unionByName(sil), a.output, ["pos"])
    elif a.command == "dictfilter":
        full = readers.read_dictionary(spark, a.dictionary, strict=False)
        must = readers.read_dictionary(spark, a.must, strict=False) if a.must else full.limit(0)
        words = readers.read_word_lists(spark, a.corpus) if a.corpus else full.select("word").limit(0)
        got = lexicon.filtered_dictionary(full, must, words, a.max, a.max_runes, a.min_distance)
        every = full.select("word", "reading", "phonemes").unionByName(must.select("word", "reading", "phonemes")).dropDuplicates(["word", "phonemes"])
        writers.write_dictionary(got.join(every, ["word", "phonemes"], "left"), a.output, ["grp", "pos"])
        for w in lexicon.missing_report(words.withColumnRenamed("word", "w"), full)[0]:
            print("not in the dictionary:", w)
    elif a.command == "wikitext":
        writers.write_lines(readers.page_sentences(readers.read_pages(spark, a.dump, a.max_pages)), F.col("sentence"), a.output)
    elif a.command == "lmtext":
        s = readers.article_sentences(spark.read.text(a.inputs)).select(F.monotonically_increasing_id().alias("id"), F.col("sentence").alias("line"))
        words = cut_lineage(lexicon.tokenised(s, tokeniser))
        kept = lexicon.all_in_dictionary(words, readers.read_dictionary(spark, a.dict), "id", min_words=a.min_words)
        writers.write_lines(kept, X.join_words(F.col("words")), a.output)
    elif a.command == "lmbuild":
        writers.write_arpa(lm.build(readers.read_corpus(spark, *a.inputs), a.order), a.output)
    elif a.command in ("cvimport", "jsutimport"):
        d = readers.read_dictionary(spark, a.dict)
        if a.command == "cvimport":
            rows = lexicon.vote_filter(readers.read_validated(spark, f"{a.root}/validated.tsv"), a.min_votes)
            rows = rows.select(F.col("path").alias("id"), "sentence", F.concat(F.lit(f"{a.root}/clips/"), "path").alias("source"), F.concat(F.lit(f"{a.wav_dir}/"), X.wav_name(F.col("path"))).alias("wav_path"))
        else:
            rows = readers.read_transcripts(spark, a.root).select(F.concat_ws("/", "subset", "utt").alias("id"), "sentence", F.col("wav_path").alias("source"), F.concat(F.lit(f"{a.wav_dir}/"), "utt", F.lit(".wav")).alias("wav_path"))
        kept = imported(rows, d, a.min_words, tokeniser)
        if a.convert:
            kept = cut_lineage(converted(kept, a.convert, "source", "wav_path"))
            kept.where("converted").count()
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(a.wav_dir).select(F.regexp_replace("path", "^file:", "").alias("path"))
        writers.write_manifest(kept.select("wav_path", "words"), files, a.output)
    elif a.command == "corpusgen":
        writers.write_lines(corpus.generated(spark), F.col("sentence"), a.output)
    elif a.command in ("train", "dnntrain"):
        d = readers.read_dictionary(spark, a.dict)
        u = cut_lineage(utterances(spark, a.manifest.split(","), a.no_augment_manifest.split(",") if a.no_augment_manifest else [], a.wavs, d, cfg, a.augment))
        if a.command == "train":
            mono = acoustic.train_monophones(u, P.PHONEMES, a.mix, a.iterations, a.align_iterations)
            if a.triphone:
                mono = acoustic.train_triphones(cut_lineage(acoustic.triphone_segments(u, mono)), mono, a.tri_mix or None, a.min_tri_seg, a.iterations)
            acoustic.save_model(spark, mono, a.output)
        else:
            model = acoustic.load_model(spark, a.am)
            aligned = u.join(acoustic.forced_alignment(u, model).where("error is null").select("utt_id", "states"), "utt_id")
            net = new_network(cfg.dim, a.hidden, a.context, a.layers, a.dropout, a.batch_norm)
            rows = cut_lineage(network.training_rows(aligned, a.context))
            prior = acoustic.class_priors(rows.groupBy(F.col("target").alias("cls")).agg(F.count("*").alias("n")), 3 * len(P.PHONEMES))
            net.log_prior = prior.orderBy("cls").toPandas()["log_prior"].to_numpy()
            for line in network.train(rows, net, a.epochs, a.rate, a.batch, patience=a.patience, smooth=a.smooth, schedule=a.schedule):
                print(*(f"{x:.4f}" for x in line))
            network.save_network(spark, net, a.output)
    elif a.command == "tuner":
        r = decoder.recognizer(spark, a.am, a.lm, a.dict, a.dnn, oov_log10=a.oov_prob, search=SearchConfig(beam=a.beam, lm_interpolation=a.lm_interp))
        cases = readers.read_manifest(spark, *a.manifest.split(","), comments=True).join(read_wav(spark, a.wavs).where("error is null").withColumnRenamed("path", "wav_path"), "wav_path")
        rows = cut_lineage(cases.select("expected", mfcc(F.col("samples"), cfg).alias("features"))).where("features is not null")
        out = cut_lineage(decoder.tuned(rows, decoder.grid(spark, _numbers(a.lm_weights, float), _numbers(a.word_penalties, float), _numbers(a.max_tokens, int), _numbers(a.max_word_ends, int)), r))
        out.orderBy("rank").show(1000, truncate=False)
        if a.output:
            writers.write_ranking(out, a.output)
    elif a.command == "transcript":
        search = SearchConfig(a.beam, a.max_tokens, a.lm_weight, a.word_penalty, a.lm_interp, a.max_word_ends)
        r = decoder.recognizer(spark, a.am, a.lm, a.dict, a.dnn, oov_log10=a.oov_prob, vtln=a.vtln, search=search)
        for path in a.wavs:
            decoder.recognize_files(spark, path, r).select("path", "result.*").show(1000, truncate=False)


if __name__ == "__main__":
    main()
