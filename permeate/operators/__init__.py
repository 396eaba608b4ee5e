"""permeate.operators"""
