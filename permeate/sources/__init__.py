"""permeate.sources"""
