"""A small inline code base; the driver's tables hold prose only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

ENGINE = """use std::collections::HashMap;
use crate::store;

/// Runs plans.
pub struct Engine {
    pub name: String,
    cache: HashMap<String, u64>,
}

impl Engine {
    pub fn open(path: &str) -> Engine {
        let store = store::load(path);
        Engine { name: store.name, cache: HashMap::new() }
    }

    fn run(&self, plan: &str) -> u64 {
        if plan.is_empty() {
            return 0;
        }
        self.cost(plan)
    }

    fn cost(&self, plan: &str) -> u64 {
        plan.len() as u64
    }
}
"""

PLAN = '''import os
from pathlib import Path


class Plan:
    """A plan."""

    def cost(self):
        return estimate(self)


async def estimate(plan):
    return 1


def main():
    plan = Plan()
    print(plan.cost())
    print(estimate(plan))
'''

VIEW = """import { load } from "./load";

export interface Row {
  id: number;
}

export const LIMIT = 10;

export function show(rows) {
  return rows.slice(0, LIMIT);
}

function hidden() {
  return show([]);
}
"""

SERVER = """package main

import "fmt"

func main() {
    fmt.Println("Engine")
}
"""

FILES = [("src/engine.rs", ENGINE), ("src/plan.py", PLAN), ("web/view.ts", VIEW), ("cmd/server.go", SERVER), ("notes/empty.txt", ""), ("notes/plain.txt", "no code here\n")]


def code_files(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FILES, "path string, content string")
